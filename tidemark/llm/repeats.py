"""Suffix-array removal of repeated passages: bytes covered by a string of WIDTH
bytes that also starts in an earlier document.

Only the first WIDTH bytes of a suffix matter, so the suffixes of the corpus are
dealt to buckets by content: by the least hash of the SEED-byte strings inside
those WIDTH bytes. Equal beginnings have equal minimisers and so meet in one
bucket. Neighbouring suffixes mostly share their minimiser, so they travel
together, as one segment of bytes. A seed is long enough to be as rare as the
passages that hold it, and a task ships each different segment once, for the least
of its documents; later copies in the same task need no shipping. So a
passage that repeats throughout the corpus sends its bucket one copy a task.

In a bucket, equal segments are found first; all but the first document's are
repeated throughout. The suffixes of the other segments that have a twin are put into
suffix order, and neighbours are compared for their longest common prefix. For each
place of that order the previous and the next place of a smaller document are found;
the least common prefixes on the way there give the longest previous factor, the longest
string that starts here and in an earlier document too. A factor of WIDTH bytes or more is
removed; a suffix without a twin has none. Nothing is judged on what is left, and the
first copy stays.

Null texts count as empty. Rows with a null doc_id count as later than all others
and as one document. Rows with one doc_id are one document, so what they share with each
other stays, but each has spans of its own: where ids repeat, a row is known by its id and
a hash of its text. Texts shorter than WIDTH lose nothing. Empty tables give empty
results. Extra columns are dropped by repeat_report.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import importable, slices, stage_table
from tidemark.llm.shingles import M1, M2, mix

WIDTH = 50
SEED = 16
#: Suffixes in one segment at most; it splits longer runs of one minimiser (in a run of one letter, say).
RUN = 35
#: Bytes of text for one bucket, and those that a task holds before it ships.
BUCKET, HELD = 2_000_000, 20_000_000
#: Bytes whose suffixes are hashed at a time.
CHUNK = 2_000_000
#: Places that are hashed at a time where a task judges, so that they stay near the processor.
NEAR = 40_000
LAST = (1 << 63) - 1


def _hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of `width` bytes."""
    n = len(flat) - width + 1
    words = [np.ndarray((max(0, len(flat) - 7),), "<u8", flat.tobytes(), strides=(1,))] if len(flat) >= 8 else []
    h = np.full(n, np.uint64(width * int(M1) & 0xFFFFFFFFFFFFFFFF))
    at = 0
    while at + 8 <= width:
        h = mix(h * M1 + words[0][at : at + n])
        at += 8
    if at < width:  # the last eight bytes, overlapping
        h = mix(h * M1 + words[0][width - 8 : width - 8 + n])
    return h


def _hash_runs(flat: np.ndarray, start: np.ndarray, long: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes from each of `long` places from each start on; it only picks candidates, the bytes themselves decide.

    All places of flat are hashed in order, which costs less than to fetch the bytes of the chosen ones.
    """
    words = np.ndarray((len(flat) - 7,), "<u8", flat.tobytes(), strides=(1,))
    n = len(flat) - width + 1
    out = []
    firsts = np.searchsorted(start, np.arange(0, n + NEAR, NEAR))
    for a, z in zip(firsts, firsts[1:]):  # starts ascend
        if a == z:
            continue
        low, high = int(start[a]), int((start[a:z] + long[a:z]).max())
        h = np.zeros(high - low, np.uint64)
        for k in [*range(0, width - 7, 8), width - 8]:
            h ^= words[low + k : high + k]
            h *= M1
            h ^= h >> np.uint64(29)
        size = long[a:z]
        out.append(h[np.repeat(start[a:z] - low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])
    return np.concatenate([np.zeros(0, np.uint64), *out])


def _twins(h: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once; values are sorted without their places, which is quick."""
    sorted_ = np.sort(h)
    values = np.unique(sorted_[1:][sorted_[1:] == sorted_[:-1]])
    top = np.zeros(1 << 20, bool)
    top[values >> np.uint64(44)] = True
    at = np.flatnonzero(top[h >> np.uint64(44)])
    return at[values[np.minimum(np.searchsorted(values, h[at]), len(values) - 1)] == h[at]] if len(values) else at


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least value in each run of `width` values."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments(texts: list[bytes], width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first suffix and number of suffixes of each segment, and its minimiser."""
    lens = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lens) - lens
    flat = np.frombuffer(b"".join(texts), np.uint8)
    if len(flat) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    low = _least(_hashes(flat, seed), width - seed + 1)  # one for each suffix of the joined bytes
    suffixes = np.maximum(lens - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), suffixes)
    place = np.arange(int(suffixes.sum())) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
    low = low[place + starts[owner]]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    long = np.diff(np.append(begin, len(low)))
    if len(long) and long.max() > RUN:
        pieces = -(-long // RUN)
        inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(begin, pieces) + inner * RUN
        long = np.diff(np.append(begin, len(low)))
    return owner[begin], place[begin], long, low[begin]


def _cells(flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The byte strings flat[start : start + size] as fixed cells, filled up with zeros."""
    out = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(width, np.uint8)]), width)[start]
    out[np.arange(width) >= size[:, None]] = 0
    return np.ascontiguousarray(out).view(f"S{width}").ravel()


def _group(cells: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that holds equal cells of one size together, by document in each group, and the number of each row's group in that order.

    Rows go by a hash of their bytes and size; neighbours of one hash are compared. Should one hash have different bytes,
    the bytes give the order.
    """
    width = cells.itemsize
    body = cells.view(np.uint8).reshape(len(cells), width)
    h = size.astype(np.uint64) * M2
    for k in [*range(0, width - 7, 8), width - 8]:
        h = (h ^ np.ascontiguousarray(body[:, k : k + 8]).view("<u8").ravel()) * M1
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    h = h[order]
    near = h[1:] == h[:-1]
    twins = np.flatnonzero(near)
    a, b = order[twins], order[twins + 1]
    if not ((cells[a] == cells[b]) & (size[a] == size[b])).all():
        order = np.lexsort((doc, size))
        order = order[np.argsort(cells[order], kind="stable")]
        near = (cells[order][1:] == cells[order][:-1]) & (size[order][1:] == size[order][:-1])
        return order, np.concatenate([[0], np.cumsum(~near)])
    group = np.concatenate([[0], np.cumsum(~near)])
    # Only rows of groups of two or more need the order of documents.
    many = np.zeros(len(order), bool)
    many[twins], many[twins + 1] = True, True
    at = np.flatnonzero(many)
    order[at] = order[at][np.lexsort((doc[order[at]], group[at]))]
    return order, group


def _ship(docs: np.ndarray, marks: np.ndarray, texts: list[bytes], buckets: int, width: int, seed: int):
    """One record for each bucket: segments of this task to be judged there, and bytes already known as repeated."""
    lens = np.array([len(t) for t in texts], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(lens) // CHUNK, prepend=-1))
    parts = [(a, segments(texts[a:z], width, seed)) for a, z in zip(cuts, [*cuts[1:], len(texts)], strict=True)]
    owner, place, long, low = (np.concatenate([p[i] + a if i == 0 else p[i] for a, p in parts]) for i in range(4))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    start = (np.cumsum(lens) - lens)[owner] + place if len(owner) else place
    size = long + width - 1
    doc = docs[owner]
    bucket = (mix(low) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
    pack = zstandard.ZstdCompressor(level=3).compress
    gone = []
    for b in np.flatnonzero(np.diff(ends)):
        rows = by[ends[b] : ends[b + 1]]
        cells = _cells(flat, start[rows], size[rows], width + RUN - 1)
        order, group = _group(cells, size[rows], doc[rows])
        rows = rows[order]
        head = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        # Copies within the first document share its verdict: each of them is shipped.
        first = doc[rows[head]][group] == doc[rows]
        gone.append(rows[~first])
        send = np.sort(rows[first])  # in the order of texts, where numbers pack well
        body = b"".join(texts[o][p : p + s] for o, p, s in zip(owner[send], place[send], size[send], strict=True))
        yield {"bucket": int(b), "body": pack(body), "doc": pack(np.diff(doc[send], prepend=0).astype("<i8").tobytes()), "mark": pack(marks[owner[send]].tobytes()) if marks.any() else None, "place": pack(place[send].astype("<i4").tobytes()), "long": pack(long[send].astype("<u1").tobytes()), "gone": None}
    o = np.concatenate([np.zeros(0, np.int64), *gone])
    if len(o):  # one record of the task has them all, joined where they touch
        spans = np.stack(_merged(doc[o], marks[owner[o]], place[o], place[o] + size[o]))
        yield {"bucket": int(mix(spans[0, :1].astype(np.uint64))[0] % np.uint64(buckets)), "body": None, "doc": None, "mark": None, "place": None, "long": None, "gone": pack(spans.astype("<i8").tobytes())}


def _merged(d: np.ndarray, m: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches a to z of the rows (document d, mark m), joined where they overlap or touch."""
    order = np.lexsort((a, m, d))
    d, m, a, z = d[order], m[order], a[order], z[order]
    if not len(d):
        return d, m, a, z
    far = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (m[1:] != m[:-1])])).astype(np.int64) * (1 << 40)
    reach = np.maximum.accumulate(z + far)
    begin = np.flatnonzero(np.concatenate([[True], (a + far)[1:] > reach[:-1]]))
    return d[begin], m[begin], a[begin], np.maximum.reduceat(z, begin)


def common_prefixes(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix, up to width, of each place's bytes with those of the place before; 0 for the first."""
    out = np.zeros(len(at), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(width, np.uint8)]), width)
    for k in range(1, len(at), 200_000):
        rows = at[k - 1 : k + 200_000]
        same = windows[rows[1:]] == windows[rows[:-1]]
        out[k : k + len(rows) - 1] = np.where(same.all(1), width, same.argmin(1))
    return out


def smaller_before(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place of a suffix order the longest prefix that it shares with the previous place of a smaller document; 0 without one.

    A place points to one before it, with no smaller document between; while the one it points to isn't smaller
    either, it takes over that one's pointer. Distances double, so a few rounds do for all places.
    """
    n = len(doc)
    to, low = np.arange(n) - 1, lcp.copy()
    open_ = np.flatnonzero((to >= 0) & (doc[np.maximum(to, 0)] >= doc))
    while len(open_):
        step = to[open_]
        to[open_], low[open_] = to[step], np.minimum(low[open_], low[step])
        open_ = open_[(to[open_] >= 0) & (low[open_] > 0)]
        open_ = open_[doc[to[open_]] >= doc[open_]]
    bad = (to < 0) | (doc[np.maximum(to, 0)] >= doc)
    low[bad] = 0
    return low


def previous_factors(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each place of a suffix order: the better one of its two neighbours of smaller documents."""
    after = np.append(lcp[1:], 0)[::-1]
    return np.maximum(smaller_before(doc, lcp), smaller_before(doc[::-1], after)[::-1])


_FIELDS = ("body", "doc", "mark", "place", "long", "gone")
_SCHEMA = pa.schema([("bucket", pa.int64()), *[(f, pa.binary()) for f in _FIELDS]])


def _judge(table: pa.Table, width: int) -> pa.Table:
    """doc, mark, start and stop of all repeated bytes of a bucket."""
    unpack = zstandard.ZstdDecompressor().decompress
    full = table.filter(pa.compute.is_valid(table["body"]))
    read = lambda name, kind: [np.frombuffer(unpack(x), kind) for x in full[name].to_pylist()]
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    docs = [np.cumsum(x) for x in read("doc", "<i8")]
    doc, place, long = join(docs), join(read("place", "<i4")), join(read("long", "<u1"))
    mark = join([np.frombuffer(unpack(x), "<i8") if x else np.zeros(len(d), np.int64) for x, d in zip(full["mark"].to_pylist(), docs, strict=True)])
    size = long + width - 1
    flat = np.frombuffer(b"".join(unpack(x) for x in full["body"].to_pylist()), np.uint8)
    found = [tuple(np.frombuffer(unpack(x), "<i8").reshape(4, -1)) for x in table["gone"].to_pylist() if x]
    if len(doc):
        start = np.cumsum(size) - size
        cells = _cells(flat, start, size, width + RUN - 1)
        order, group = _group(cells, size, doc)
        head = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        later = doc[order] != doc[order[head]][group]
        o = order[later]
        found.append((doc[o], mark[o], place[o], place[o] + size[o]))
        # One segment for each group now stands for its first document; twins among its suffixes are looked for.
        o = np.sort(order[~later])
        h = _hash_runs(flat, start[o], long[o], width)
        twin = _twins(h)
        ends = np.cumsum(long[o])
        row = np.searchsorted(ends, twin, side="right")
        which, step = o[row], twin - (ends - long[o])[row]
        at = start[which] + step
        if len(at):
            order = np.argsort(_cells(flat, at, np.full(len(at), width), width), kind="stable")
            factor = previous_factors(doc[which][order], common_prefixes(flat, at[order], width))
            o = order[factor >= width]
            found.append((doc[which[o]], mark[which[o]], place[which[o]] + step[o], place[which[o]] + step[o] + width))
    rows = _merged(*(join([f[i] for f in found]) for i in range(4)))
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("doc", "mark", "start", "stop"), rows, strict=True)})


def repeated_bytes(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc, mark, start and stop: stretches of bytes that repeat an earlier document. docs: doc and mark (long), text."""
    importable(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, math.ceil(total / BUCKET))

    def run(batches):
        def out(held):
            ids, marks = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            rows = list(_ship(ids, marks, [t for h in held for t in h[2]], buckets, width, seed))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[k : k + 64], _SCHEMA)

        held, size = [], 0
        for batch in slices(batches, "text"):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            held.append((batch.column("doc").to_numpy(), batch.column("mark").to_numpy(), texts))
            size += sum(map(len, texts))
            if size > HELD:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    shipped = docs.select("doc", "mark", "text").mapInArrow(run, "bucket bigint, " + ", ".join(f"{f} binary" for f in _FIELDS))
    return shipped.groupBy("bucket").applyInArrow(lambda t: _judge(t, width), "doc bigint, mark bigint, start bigint, stop bigint")


def _kept(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
        text, parts, at, runs, removed = text or b"", [], 0, 0, 0
        stop = -1
        for a, z in sorted((s["start"], s["stop"]) for s in spans or ()):
            if a > stop:
                parts.append(text[at:a])
                runs += 1
                removed += z - a
                at = stop = z
            elif z > stop:
                removed += z - stop
                at = stop = z
        parts.append(text[at:])
        rows.append((len(text), removed, runs, hashlib.sha256(b"".join(parts)).hexdigest()))
    n, removed, runs, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each document."""
    doc = F.coalesce("doc_id", F.lit(LAST)).cast("long")
    repeated = docs.groupBy(doc.alias("doc")).count().filter("count > 1").limit(1).count() > 0
    # Rows of one id are told apart by their texts; rows that are equal in both have equal spans.
    mark = F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("long")
    rows = docs.select("doc_id", doc.alias("doc"), mark.alias("mark"), "text")
    spans = stage_table(repeated_bytes(rows, width), "repeats")
    own = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(own.hint("shuffle_hash"), ["doc", "mark"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in slices(batches, "text"):
            yield _kept(batch)

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
