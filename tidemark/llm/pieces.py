"""SentencePiece encoding and decoding: a unigram Viterbi search over a double-array trie.

The pieces and their scores come from a SentencePiece model file (a path; the
file is read on the driver, and the arrays built from it go to the executors:
their size is bounded by the vocabulary). Each text gets a leading white-space
marker, spaces become markers, and the best path by the sum of scores is taken;
on equal scores the path whose last piece starts first. A character that no
piece of its own covers costs the lowest score less UNKNOWN and is written as
its UTF-8 bytes. Decoding joins the pieces, turns markers into spaces, drops
the leading one, and replaces byte sequences that are no UTF-8.

Where no piece has a marker after another character, or a line feed, a text is cut
there without changing its best path, and each different cut of a batch is
searched once, all together in numpy.

A null text has null ids; an empty one has the ids of the marker alone dropped,
so none. decode(encode(text)) is the text unless it holds the marker U+2581
itself, which decodes as a space. Rows are independent, so repeated or null ids
of documents, ties and empty tables need no rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
#: Cuts with more bytes are searched one by one.
LONG = 48


@dataclass
class Vocabulary:
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # of a trie node: id of the piece that ends there, or -1
    score: np.ndarray
    unknown: float
    byte_id: np.ndarray  # of each byte value: id of its fallback piece
    flat: np.ndarray  # bytes of all pieces, markers as spaces
    offset: np.ndarray
    cuts: bool


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value arrays; the child of s by byte c is t = base[s] + c + 1 where check[t] == s."""
    trie: list[dict[int, int]] = [{}]
    ends = {}
    for key, value in zip(keys, values, strict=True):
        node = 0
        for c in key:
            nxt = trie[node].get(c)
            if nxt is None:
                nxt = trie[node][c] = len(trie)
                trie.append({})
            node = nxt
        ends[node] = value
    size = len(trie) * 2 + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    place = {0: 0}
    free = 1
    order, queue = [], [0]
    while queue:
        node = queue.pop()
        order.append(node)
        queue.extend(trie[node].values())
    tail = 1  # everything from here on is free
    for node in order:
        children = sorted(trie[node])
        if node in ends:
            value[place[node]] = ends[node]
        if not children:
            continue
        while used[free]:
            free += 1
        # A few holes are tried; then the children go behind all others.
        b = max(0, free - children[0] - 1)
        for _ in range(1 if len(children) > 8 else 24):
            if not any(used[b + c + 1] for c in children):
                break
            b += 1
        else:
            b = max(0, tail - children[0] - 1)
        if b + 600 > size:
            base, check, value = (np.concatenate([x, np.full(size, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
            used.extend(bytes(size))
            size *= 2
        base[place[node]] = b
        for c in children:
            t = b + c + 1
            used[t] = 1
            check[t] = place[node]
            place[trie[node][c]] = t
        tail = max(tail, t + 1)
    last = max(place.values()) + 300
    pad = max(0, last - size)
    return tuple(np.concatenate([x, np.full(pad, f, np.int32)])[:last] for x, f in ((base, 0), (check, -1), (value, -1)))


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    keys, ids, flat, byte_id = [], [], [], np.zeros(256, np.int32)
    score = np.array([sp.get_score(i) for i in range(n)], np.float64)
    cuts = True
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            flat.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            flat.append(b"")
        else:
            keys.append(piece.encode())
            ids.append(i)
            flat.append(piece.replace(MARK, " ").encode())
            cuts &= not re.search(f"[^{MARK}]{MARK}|\n", piece)
    base, check, value = double_array(keys, ids)
    offset = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
    return Vocabulary(base, check, value, score, float(score[ids].min()) - UNKNOWN, byte_id, np.frombuffer(b"".join(flat), np.uint8), offset, cuts)


_WIDTH = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


def _paths(v: Vocabulary, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For byte rows padded to one width: start and piece (-1: unknown character) of the best last step at each end."""
    n, width = rows.shape
    best = np.full((width + 1, n), -np.inf)
    best[0] = 0.0
    start, last = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
    columns = np.ascontiguousarray(rows.T)
    for i in range(width):
        at = np.flatnonzero((lens > i) & (best[i] > -np.inf))
        if not len(at):
            continue
        here, own = best[i, at], _WIDTH[columns[i, at]]
        single = np.zeros(len(at), bool)
        live, state = np.arange(len(at)), np.zeros(len(at), np.int32)
        for k in range(i, width):
            t = v.base[state] + columns[k, at[live]] + 1
            ok = (v.check[t] == state) & (lens[at[live]] > k)
            live, state = live[ok], t[ok]
            if not len(live):
                break
            ids = v.piece[state]
            has = ids >= 0
            if has.any():
                hit, got = live[has], ids[has]
                single[hit[own[hit] == k + 1 - i]] = True
                score, to = here[hit] + v.score[got], at[hit]
                better = score > best[k + 1, to]
                to = to[better]
                best[k + 1, to], start[k + 1, to], last[k + 1, to] = score[better], i, got[better]
        for w in (1, 2, 3, 4):
            lone = np.flatnonzero(~single & (own == w))
            if len(lone) and i + w <= width:
                to, score = at[lone], here[lone] + v.unknown
                better = score > best[i + w, to]
                to = to[better]
                best[i + w, to], start[i + w, to], last[i + w, to] = score[better], i, -1
    return start, last


def _search_long(v: Vocabulary, raw: bytes) -> list[int]:
    """The same search over one row, for long cuts."""
    base, check, piece, score = v.base, v.check, v.piece, v.score
    n = len(raw)
    best, start, last = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] == -np.inf:
            continue
        w, single, state, here = int(_WIDTH[raw[i]]), False, 0, best[i]
        for k in range(i, n):
            t = base[state] + raw[k] + 1
            if check[t] != state:
                break
            state = t
            p = piece[t]
            if p >= 0:
                single |= k + 1 - i == w
                if here + score[p] > best[k + 1]:
                    best[k + 1], start[k + 1], last[k + 1] = here + score[p], i, int(p)
        if not single and i + w <= n and here + v.unknown > best[i + w]:
            best[i + w], start[i + w], last[i + w] = here + v.unknown, i, -1
    out, at = [], n
    while at:
        s = start[at]
        out.extend([last[at]] if last[at] >= 0 else [int(v.byte_id[b]) for b in raw[s:at][::-1]])
        at = s
    return out[::-1]


def search(v: Vocabulary, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all cuts in a row, and the offset of each."""
    sizes = np.array([len(c) for c in cuts], np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # cut, position from its end, id
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] <= LONG]
    for part in np.array_split(order, max(1, len(order) // 20_000)):
        if not len(part):
            continue
        lens, width = sizes[part], int(sizes[part].max())
        rows = np.frombuffer(b"".join(cuts[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
        start, last = _paths(v, rows, lens)
        at, live, rank = lens.copy(), np.flatnonzero(lens > 0), np.zeros(len(part), np.int64)
        while len(live):
            ids, s = last[at[live], live], start[at[live], live]
            known = ids >= 0
            found.append((part[live[known]], rank[live[known]], ids[known]))
            rank[live[known]] += 1
            for j in range(1, 5):  # an unknown character's bytes, from its end
                lone = live[~known & (at[live] - j >= s)]
                if len(lone):
                    found.append((part[lone], rank[lone], v.byte_id[rows[lone, at[lone] - j]]))
                    rank[lone] += 1
            at[live] = s
            live = live[s > 0]
    for i in np.flatnonzero(sizes > LONG):
        ids = np.array(_search_long(v, cuts[i])[::-1], np.int32)
        found.append((np.full(len(ids), i), np.arange(len(ids)), ids))
    cut, back, ids = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3))
    count = np.bincount(cut, minlength=len(cuts)).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(len(ids), np.int32)
    out[offset[cut + 1] - 1 - back] = ids
    return out, offset


def _gather(flat: np.ndarray, offset: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of flat named by which, in a row, and the length of each."""
    lens = offset[which + 1] - offset[which]
    total = int(lens.sum())
    starts = np.cumsum(lens) - lens
    return flat[np.arange(total) + np.repeat(offset[which] - starts, lens)], lens


_CUT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def encode_texts(v: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text."""
    index: dict[str, int] = {}
    which = []
    for text in texts:
        marked = (MARK + text).replace(" ", MARK) if text else ""
        which.append(np.array([index.setdefault(c, len(index)) for c in (_CUT.findall(marked) if v.cuts else [marked] if marked else [])], np.int64))
    flat, offset = search(v, [c.encode("utf-8", "replace") for c in index])
    return [_gather(flat, offset, w)[0] if len(w) else np.zeros(0, np.int32) for w in which]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    text = _gather(v.flat, v.offset, np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _with(docs: DataFrame, read: str, into: str, kind: T.DataType, function) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kind)])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, function(batch.column(read))], names=[*batch.schema.names, into])

    return docs.mapInArrow(lambda batches: run(slices(batches, read)), schema)


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of `text` in the array column `into`."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def function(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        ids = encode_texts(shared.value, [x or "" for x in texts])
        return _lists(ids, [x is None for x in texts])

    return _with(docs, text, into, T.ArrayType(T.IntegerType()), function)


def _lists(ids: list[np.ndarray], missing: list[bool]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(missing))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text of the array column `ids` in `into`."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [decode_ids(shared.value, x.values.to_numpy()) if x.is_valid else None for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids and round_trip (the decoded ids are the text; null text: null)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    into = fresh(docs, "_pieces")
    kind = T._parse_datatype_string("struct<n_tokens: bigint, n_byte_tokens: bigint, ids: array<int>, round_trip: boolean>")

    def function(column: pa.Array) -> pa.Array:
        v = shared.value
        texts = column.to_pylist()
        ids = encode_texts(v, [x or "" for x in texts])
        missing = [x is None for x in texts]
        is_byte = np.zeros(len(v.score), bool)
        is_byte[v.byte_id] = True
        return pa.StructArray.from_arrays(
            [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                _lists(ids, missing),
                pa.array([None if x is None else decode_ids(v, i) == x for x, i in zip(texts, ids, strict=True)], pa.bool_()),
            ],
            names=["n_tokens", "n_byte_tokens", "ids", "round_trip"],
        )

    return _with(docs.select("doc_id", "text"), "text", into, kind, function).select("doc_id", F.col(f"{into}.*"))
