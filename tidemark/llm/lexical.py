"""Ranked lexical search: document shards of postings, integer impacts, dense accumulators, the best of all shards.

Texts are read once for each block of items. A task turns its documents into shards in CSR form (the block's terms
that occur, where each one's postings start, document numbers and counts); the shards are a table in the shared
folder. Document frequencies and lengths are added up from it. Then each shard's impacts are worked out once, as
integers, and every item of the block adds its terms' postings one term at a time into an accumulator with a cell for
each document. The best k of a shard are cut off by a partition of the scores; of those that equal the k-th score, the
smallest ids stay. A task merges its shards, two windows merge the tasks.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. All numbers but
the logarithm are integers; see `impacts` and `weights`.

Defined cases: a null or empty text has no terms and counts nowhere. Every row is a document, also where rows repeat
or share an id; null ids come after all others in a tie. Rows of one item id (null is an id) are one item with the
terms of all. An item without terms or without matches gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, importable, slices

#: Bytes of distinct terms that a block of items may hold, on average; a block is sent to all executors.
BLOCK_BYTES = 16_000_000
#: A shard ends at so many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 32_768, 64_000_000
#: Groups of tasks whose results are merged before all are.
GROUPS = 32

_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of a text to bytes of its terms: A-Z in lower case, a space for all that separates. UTF-8 beyond ASCII stays.
TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEEP else 0x20 for b in range(256))
SHARD = "ids array<bigint>, null_ids int, sizes array<bigint>, terms array<int>, starts array<bigint>, docs array<int>, counts array<bigint>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)


def damping(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m = 100 - 50 + ((50 * n * N) div L) of documents of n terms; Python's integers hold the product."""
    return np.array([50 + 50 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 * tf) div (1000 * tf + 20 * m) of each posting."""
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


class Shard:
    """Documents gathered until they are enough for one shard of postings."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.hits: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, words: list[bytes], number: dict[bytes, int]) -> None:
        found = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.hits.append(found[found >= 0])
        self.bytes += 8 * len(words)

    def row(self) -> dict:
        """The shard in CSR form, documents in order of id, null ids last."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        hits = [self.hits[i] for i in order]
        doc = np.repeat(np.arange(n), [len(h) for h in hits])
        keys, counts = np.unique(np.concatenate(hits).astype(np.int64) * n + doc, return_counts=True)
        terms, starts = np.unique(keys // n, return_index=True)
        ids = [self.ids[i] for i in order]
        return {"ids": [i or 0 for i in ids], "null_ids": sum(i is None for i in ids), "sizes": [self.sizes[i] for i in order], "terms": terms.astype(np.int32), "starts": np.append(starts, len(keys)), "docs": (keys % n).astype(np.int32), "counts": counts}


def shards(docs: DataFrame, number) -> DataFrame:
    """Shards of all documents; number: a broadcast dictionary of the terms to index."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(SHARD)

    def run(batches):
        held, kinds = Shard(), to_arrow_schema(schema)
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(text)
                if words:
                    held.add(doc_id, words, number.value)
                if len(held.ids) >= SHARD_DOCS or held.bytes >= SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist([held.row()], kinds)
                    held = Shard()
        if held.ids:
            yield pa.RecordBatch.from_pylist([held.row()], kinds)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of those equal to the last, the first ones. Not in order."""
    places = np.flatnonzero(scores > 0)
    if len(places) <= k:
        return places
    found = scores[places]
    least = found[np.argpartition(found, len(found) - k)[len(found) - k]]
    above = places[found > least]
    return np.concatenate([above, places[found == least][: k - len(above)]])


def ranked_shard(shard: dict[str, np.ndarray], items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each item with a match: its number, places and scores of its k best documents in the shard."""
    starts, docs, terms = shard["starts"], shard["docs"], shard["terms"]
    impact = impacts(shard["counts"], damping(shard["sizes"], n_docs, n_terms)[docs])
    impact *= np.repeat(weight[terms], np.diff(starts))
    place = np.full(len(weight), -1)
    place[terms] = np.arange(len(terms))
    scores = np.zeros(len(shard["ids"]), np.int64)
    for i, wanted in enumerate(items):
        here = place[wanted]
        here = here[here >= 0].tolist()
        if here:
            scores[:] = 0
            for t in here:
                a, b = starts[t], starts[t + 1]
                scores[docs[a:b]] += impact[a:b]  # a document stands once in a term's postings
            found = best(scores, k)
            if len(found):
                yield i, found, scores[found]


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each pair once."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("term", T.BinaryType())])

    def run(batches):
        for batch in slices(batches, "text"):
            lists = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            lengths = np.array([len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(np.repeat(np.arange(len(lists)), lengths))), pa.array([t for x in lists for t in x], pa.binary())], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, schema).distinct()


def _gathered(held: dict[int, tuple[np.ndarray, np.ndarray]], i: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Adds a shard's best documents to those that the task holds for item i; ids of missing ones are the largest."""
    if i in held:
        ids, scores = np.concatenate([held[i][0], ids]), np.concatenate([held[i][1], scores])
        if len(ids) > k:
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
    held[i] = ids, scores


NO_ID = np.iinfo(np.int64).max


def _block(docs: DataFrame, item_terms: DataFrame, k: int) -> DataFrame:
    """The result of one block of items, as a table in the shared folder."""
    spark = docs.sparkSession
    sc, work = spark.sparkContext, Staged()
    rows = item_terms.collect()  # a block is bounded
    vocabulary = sorted({bytes(r.term) for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r.item_id, []).append(number[bytes(r.term)])
    names, lists = list(by_item), [np.array(sorted(x), np.int32) for x in by_item.values()]

    index = work.table(shards(docs, sc.broadcast(number)), "lexical-shards")
    total = index.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("l")).first()
    n_docs, n_terms = total.n or 0, total.l or 0
    spread = index.select(F.posexplode("terms").alias("place", "term"), "starts").select("term", (F.get("starts", F.col("place") + 1) - F.get("starts", F.col("place"))).alias("n"))
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in spread.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each of the block's terms
        frequency[r.term] = r.n
    shared = sc.broadcast((lists, weights(n_docs, frequency)))

    def run(batches):
        items, weight = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                shard = {name: batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in ("ids", "sizes", "terms", "starts", "docs", "counts")}
                ids = shard["ids"].copy()
                if missing := batch.column("null_ids")[row].as_py():
                    ids[-missing:] = NO_ID
                for i, found, scores in ranked_shard(shard, items, weight, n_docs, n_terms, k):
                    _gathered(held, i, ids[found], scores, k)
        part = TaskContext.get().partitionId()
        for i, (ids, scores) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int32()), pa.array([part % GROUPS] * len(ids), pa.int32()), pa.array(ids), pa.array(scores)], names=["item", "part", "doc_id", "score"])

    found = index.mapInArrow(run, "item int, part int, doc_id bigint, score bigint")
    for keys in (("item", "part"), ("item",)):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_terms.schema["item_id"].dataType)])
    known = spark.createDataFrame(list(enumerate(names)), kind)
    out = found.join(F.broadcast(known), "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
    out = Staged().table(out, "lexical-found")
    work.drop()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (fewer if fewer match) of every item."""
    importable(docs.sparkSession)
    item_terms = _item_terms(items)
    size = item_terms.agg(F.sum(F.length("term") + 8).alias("n")).first().n or 0
    blocks = -(-size // BLOCK_BYTES)
    if not blocks:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    out = None
    for b in range(blocks):
        found = _block(docs, item_terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k)
        out = found if out is None else out.unionByName(found)
    return out
