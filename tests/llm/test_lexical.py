import collections
import math
import random
import re

import numpy as np
import pytest
from fixtures import SCHEMA, documents, frame

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    texts = [(i, collections.Counter(TERM.findall((t or "").translate(ASCII)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in texts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in texts for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall((t or "").translate(ASCII)))
    out = []
    for item, terms in wanted.items():
        found = []
        for (i, c), n in zip(texts, sizes):
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, missing, i) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if missing else i, -score))
    return sorted(out, key=str)


ITEMS = [(1, "one two x stone"), (2, None), (3, ""), (4, "nowhere-to.be FOUND"), (5, "Größe 日本語のテキスト, the THE the of"), (None, "river lamp"), (6, "reed"), (6, "best line; reed"), (7, "ab\x7fcd stone's paper_green")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 0, "z") for i, t in ITEMS], "item_id bigint, text string, rank int, score string")


@pytest.mark.parametrize("k, shard, block", [(50, 32_768, 16_000_000), (3, 4, 16_000_000), (1, 1, 40), (7, 5, 90)])
def test_search_against_brute_force(spark, items, monkeypatch, k, shard, block):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    got = lexical.search(frame(spark).repartition(3), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r[0], r[1]) for r in documents()], ITEMS, k)


def test_long_text_and_ties(spark):
    rows = [(i, "tie word", "", "", 0, "", 0.0, 0, "") for i in range(200, 0, -1)] + [(500, "tie " * 300_000, "", "", 0, "", 0.0, 0, "")]
    rows += [(None, "tie word", "", "", 0, "", 0.0, 0, "")] * 3
    items = [(1, "word"), (2, "TIE")]
    got = lexical.search(frame(spark, rows).repartition(7), spark.createDataFrame(items, "item_id bigint, text string"), 20)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r[0], r[1]) for r in rows], items, 20)


def test_best_is_tie_safe():
    rng = random.Random(2)
    for _ in range(300):
        scores = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 30))])
        want = sorted((p for p in range(len(scores)) if scores[p] > 0), key=lambda p: (-scores[p], p))
        k = rng.randrange(1, 12)
        assert sorted(lexical.best(scores, k)) == sorted(want[:k])


def test_empty_tables(spark, items):
    none = spark.createDataFrame([], SCHEMA)
    assert lexical.search(none, items).count() == 0
    assert lexical.search(frame(spark), items.limit(0)).count() == 0
    assert lexical.search(frame(spark), items.filter("item_id = 2")).columns == ["item_id", "rank", "doc_id", "score"]
