"""Token ids in framed binary record files with an offset index, written in id order and read back in pieces.

Every record of a file is one document:

    uint64  length of the payload            uint32  masked CRC-32 of these eight bytes
    payload                                  uint32  masked CRC-32 of the payload

and its payload is `int64 doc_id, uint8 has_id, uint8 width, uint64 ids before it in this file`, then its token ids in
`width` bytes each: two where the vocabulary has at most 65,536 entries, else four. All numbers are little-endian. A masked checksum is the CRC rotated right by 15 bits plus a constant, so that a
checksum of bytes that hold checksums stays useful. The index is a Parquet table beside the files (file, part,
doc_id, offset, n_bytes, n_ids); a reader that wants records in any order needs nothing else.

Defined cases: a null text is an empty one; every document ends with id 0. Documents are in ascending order of
doc_id, null ids first, rows of one id in order of a hash of their text, then of the text. Repeated rows stay. An
empty table gives an index without rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, _folder, importable, shared_folder, slices

END = 0  # the id after every document
HEAD, LENGTH, CHECK = "<qBBQ", "<Q", "<I"
HEAD_BYTES, FRAME = struct.calcsize(HEAD), struct.calcsize(LENGTH) + 2 * struct.calcsize(CHECK)
MASK = 0xA282EAD8
#: Words kept with their ids in a worker, and the longest that is kept.
WORDS, WORD_CHARS = 1_500_000, 64
#: A reader's task gets about this many bytes of a file.
SPAN = 16_000_000
#: Tasks of a read at most; beyond that a task reads several spans in turn.
READERS = 20_000
INDEX = "file string, part int, doc_id bigint, offset bigint, n_bytes bigint, n_ids bigint"


class BadRecord(ValueError):
    """A frame whose lengths or checksums don't agree."""


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack(LENGTH, len(payload))
    return b"".join((length, struct.pack(CHECK, masked(length)), payload, struct.pack(CHECK, masked(payload))))


def payloads(data: bytes, name: str = "") -> Iterator[memoryview]:
    """The payloads of whole frames, one after another; raises BadRecord at the first that is damaged or cut."""
    view, at = memoryview(data), 0
    while at < len(view):
        if len(view) - at < FRAME:
            raise BadRecord(f"{name}: cut frame at byte {at}")
        length = view[at : at + 8]
        if struct.unpack_from(CHECK, view, at + 8)[0] != masked(length):
            raise BadRecord(f"{name}: damaged length at byte {at}")
        n = struct.unpack(LENGTH, length)[0]
        if at + n + FRAME > len(view):
            raise BadRecord(f"{name}: cut payload at byte {at}")
        payload = view[at + 12 : at + 12 + n]
        if struct.unpack_from(CHECK, view, at + 12 + n)[0] != masked(payload):
            raise BadRecord(f"{name}: damaged payload at byte {at}")
        yield payload
        at += n + FRAME


def record(doc_id: int | None, before: int, ids: bytes, width: int) -> bytes:
    """The frame of one document: `before` ids stand before it in its file, `ids` are its own without the end."""
    return framed(struct.pack(HEAD, doc_id or 0, doc_id is not None, width, before) + ids + END.to_bytes(width, "little"))


def parsed(payload: memoryview) -> tuple[int | None, int, np.ndarray]:
    """doc_id, ids before it in its file, its ids."""
    doc_id, has_id, width, before = struct.unpack_from(HEAD, payload)
    return doc_id if has_id else None, before, np.frombuffer(payload[HEAD_BYTES:], f"<u{width}")


class Encoder:
    """Ids of whole texts as little-endian bytes of `width` each, the same as the library's.

    This tokenizer cuts before every space that a visible character follows, whatever stands on either side, and
    pairs bytes only between cuts. So a text is the words between such spaces, and words met before need no search.
    Texts for which that cut isn't plain (runs of white space, special tokens) go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")  # how byte-level pieces write a space
        self.later: dict[str, bytes] = {}
        self.marks = dict(zip(".,;:!?", self.whole(list(".,;:!?"))))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, f"<u{self.width}").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(word: str) -> bool:
        """Whether a space before this word is a cut: it starts with a character that is surely visible."""
        return bool(word) and ("!" <= word[0] <= "~" or word[0].isalpha())

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each plain word with a space before it, from a few long texts: only first tokens hold a space."""
        out = []
        for k in range(0, len(words), 2_000):
            some = words[k : k + 2_000]
            ids = np.asarray(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(some):
                raise ValueError("this tokenizer doesn't cut before spaces")
            data, at = ids.tobytes(), (starts * self.width).tolist()
            out += map(data.__getitem__, map(slice, at, [*at[1:], len(data)]))
        return out

    def _learned(self, words: set[str]) -> dict[str, bytes]:
        """Ids of plain words that aren't known yet. A mark after letters is always cut off, so only the letters are searched."""
        stems = {w: w[:-1] for w in words if w[-1] in self.marks and w[:-1].isalpha()}
        listed = list({stems.get(w, w) for w in words}.difference(self.later))
        out = dict(zip(listed, self._spaced(listed)))
        for w, stem in stems.items():
            out[w] = (out.get(stem) or self.later[stem]) + self.marks[w[-1]]
        if len(self.later) + len(out) > WORDS:
            self.later.clear()
        self.later.update((w, x) for w, x in out.items() if len(w) <= WORD_CHARS)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        parts = [[""] if i in odd else t.split(" ") for i, t in enumerate(texts)]
        found = [list(map(self.later.get, w[1:])) for w in parts]
        holes = [i for i, f in enumerate(found) if None in f]
        new = {w for i in holes for w, x in zip(parts[i][1:], found[i]) if x is None}
        strange = {w for w in new if not self._plain(w)}
        if strange:
            odd.update(i for i in holes if not strange.isdisjoint(parts[i][1:]))
        learned = self._learned(new - strange)
        firsts = list({w[0] for w in parts})
        first = dict(zip(firsts, self.whole(firsts)))
        out: list[bytes] = [b""] * len(texts)
        for i in holes:
            if i not in odd:
                found[i] = [learned[w] if x is None else x for w, x in zip(parts[i][1:], found[i])]
        for i, f in enumerate(found):
            if i not in odd:
                out[i] = first[parts[i][0]] + b"".join(f)
        whole = sorted(odd)
        for i, x in zip(whole, self.whole([texts[i] for i in whole]) if whole else ()):
            out[i] = x
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def folder_of(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes docs' ids to record files in `folder` (a new one in the shared folder if None); gives index and folder.

    Tasks name their files by themselves; only files that the index names are part of the output, so attempts that
    fail or run twice leave nothing but files that nobody reads, and these are deleted at the end.
    """
    spark = docs.sparkSession
    importable(spark)
    own = folder is None
    files, where = _folder(spark, folder or f"{shared_folder(spark)}/records-{uuid.uuid4().hex}")
    where = files.makeQualified(where)
    files.mkdirs(where)
    if own:
        files.deleteOnExit(where)
    uri = where.toString()

    def run(batches):
        (fs, top), own = folder_of(uri), encoder(tokenizer)
        part = TaskContext.get().partitionId()
        name, at, before, out = f"part-{part:06d}-{uuid.uuid4().hex}.rec", 0, 0, None
        try:
            for batch in slices(batches, "text", 4_000_000):
                out = out or fs.open_output_stream(f"{top}/{name}")
                ids, offsets, sizes, counts = batch.column("doc_id").to_pylist(), [], [], []
                for doc_id, x in zip(ids, own.encode([t or "" for t in batch.column("text").to_pylist()])):
                    n = len(x) // own.width + 1
                    framed_ids = record(doc_id, before, x, own.width)
                    out.write(framed_ids)
                    offsets.append(at)
                    sizes.append(len(framed_ids))
                    counts.append(n)
                    at, before = at + len(framed_ids), before + n
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(ids)), "part": pa.array([part] * len(ids), pa.int32()), "doc_id": batch.column("doc_id"), "offset": pa.array(offsets, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_ids": pa.array(counts, pa.int64())})
        finally:
            if out is not None:
                out.close()

    tie = [F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", tie[0].alias("tie"), tie[1].alias("row"))
    ordered = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    index = Staged().table(ordered.mapInArrow(run, INDEX), "records-index") if own else _index(ordered.mapInArrow(run, INDEX), f"{uri}/index")
    used = {r.file for r in index.select("file").distinct().collect()}  # one name for each task
    fs, top = folder_of(uri)
    for x in fs.get_file_info(pa.fs.FileSelector(top)):
        if x.base_name.endswith(".rec") and x.base_name not in used:
            fs.delete_file(x.path)
    return index, uri


def _index(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def record_rows(index: DataFrame, folder: str, fields: str, row) -> DataFrame:
    """Rows that row(payload) gives for every record that index names, read in spans of neighbouring records."""
    spark = index.sparkSession
    importable(spark)
    schema = spark.createDataFrame([], f"file string, part int, {fields}").schema
    spans = index.groupBy("file", "part", F.floor(F.col("offset") / SPAN).alias("span")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("n_bytes")).alias("stop"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        names = [f.name for f in schema.fields[2:]]
        kinds = to_arrow_schema(schema)
        fs, top = folder_of(folder)
        for batch in batches:
            for span in batch.to_pylist():
                with fs.open_input_file(f"{top}/{span['file']}") as source:
                    data = source.read_at(span["stop"] - span["start"], span["start"])
                rows = [row(p) for p in payloads(data, span["file"])]
                columns = [pa.array([r[i] for r in rows], kinds.field(n).type) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([pa.array([span["file"]] * len(rows)), pa.array([span["part"]] * len(rows), pa.int32()), *columns], schema=kinds)

    return spans.repartition(max(1, min(spans.count(), READERS))).mapInArrow(run, schema)


def digest(payload: memoryview) -> tuple:
    """doc_id, ids before it in its file, number of ids, CRC-32 of the ids as 32-bit numbers."""
    doc_id, before, ids = parsed(payload)
    return doc_id, before, len(ids), zlib.crc32(ids.astype("<u4"))


def token_ids(index: DataFrame, folder: str) -> DataFrame:
    """doc_id and ids of every record that index names, any rows of a written index in any order: one seek for each."""
    importable(index.sparkSession)

    def run(batches):
        fs, top = folder_of(folder)
        for batch in batches:
            ids, held = [], {}
            for r in batch.to_pylist():
                if r["file"] not in held:
                    if len(held) >= 16:
                        held.pop(next(iter(held))).close()
                    held[r["file"]] = fs.open_input_file(f"{top}/{r['file']}")
                (payload,) = payloads(held[r["file"]].read_at(r["n_bytes"], r["offset"]), r["file"])
                ids.append(parsed(payload)[2].astype(np.int64))
            for x in held.values():
                x.close()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return index.select("file", "offset", "n_bytes", "doc_id").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def token_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all taken from the files that write_records has written."""
    spark: SparkSession = docs.sparkSession
    index, folder = write_records(docs, tokenizer)
    read = record_rows(index, folder, "doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint", digest)
    bases, so_far = [], 0
    for r in index.groupBy("part", "file").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each task that wrote
        bases.append((r.file, so_far))
        so_far += r.n
    base = spark.createDataFrame(bases, "file string, base bigint")
    return read.join(F.broadcast(base), "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
