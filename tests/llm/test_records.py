import random
import struct
import zlib

import pytest
from fixtures import SCHEMA, documents, frame

from tidemark.llm import records

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_words_are_cut_as_by_the_library():
    rng, enc = random.Random(3), records.Encoder(PATH)
    pieces = [" ", "  ", " ", "\n", "\t", "a", "é", "'s", "1", "!", "<|endoftext|>", "日", " ", " ", "\x1c", "_", "🙂", "word", "Ġ"]
    for e in ("", "<|endoftext|>"):
        some = [p for p in pieces if p != e]
        texts = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(4000)] + [None or "", "x" * 100_000, " ".join("ab" * (k % 90) for k in range(5000))]
        assert enc.encode(texts) == enc.whole(texts)
        assert enc.encode(texts) == enc.whole(texts)  # from the words kept


def test_full_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(records, "WORDS", 5)
    enc = records.Encoder(PATH)
    texts = [" ".join(f"w{k % 17}" for k in range(n)) for n in range(40)]
    assert [x for t in texts for x in enc.encode([t])] == enc.whole(texts)


def test_frames():
    data = records.framed(b"") + records.framed(b"abc")
    assert [bytes(p) for p in records.payloads(data)] == [b"", b"abc"]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(records.BadRecord):
            list(records.payloads(bytes(broken)))
    for n in range(1, records.FRAME + 3):
        with pytest.raises(records.BadRecord):
            list(records.payloads(data[:-n]))


def test_report_against_library(spark, monkeypatch):
    rows = documents()
    got = sorted(map(tuple, records.token_report(frame(spark).repartition(5), PATH).collect()), key=lambda r: (r[1], r[0] or 0))
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(plain_ids(r[1]))
    assert len(got) == len(rows) and [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at and any(n == len(x) and crc == zlib.crc32(struct.pack(f"<{n}I", *x)) for x in ids[doc_id])
        at += n


def test_spans_and_shuffled_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "SPAN", 700)
    folder = f"file://{tmp_path}/records"
    index, where = records.write_records(frame(spark).repartition(3), PATH, folder)
    want = sorted((r[0] or -1, plain_ids(r[1])) for r in documents())
    read = records.token_ids(index.orderBy("n_ids").limit(1000), where)
    assert sorted((r.doc_id or -1, r.ids) for r in read.collect()) == want
    spans = records.record_rows(index, where, "doc_id bigint, before bigint, n bigint, crc bigint", records.digest)
    assert sorted((r.doc_id or -1, r.n) for r in spans.collect()) == sorted((i, len(x)) for i, x in want)
    files = {p.name for p in (tmp_path / "records").glob("*.rec")}
    assert files == {r.file for r in index.select("file").distinct().collect()}


def test_empty_table(spark):
    assert records.token_report(spark.createDataFrame([], SCHEMA), PATH).count() == 0
