"""Language-model scores from Brown classes.

Words of the training documents are counted without a limit (a table, never on
the driver). The SEEDS most frequent ones are put into classes by exchange
clustering on the driver: each word in turn moves to the class that gives the class
bigrams the highest likelihood, until nothing moves. Then every other word that
occurs twice or more is exchanged too, all at once and spread over the executors:
what it gains in each class needs only the counts of its neighbours' classes. Words
that occur once stand for unseen ones and share a class with them; the end of a text is
one of its own. The number of classes rises with the cube root of the vocabulary.

The probability of a token is P(class | class before) * P(word | class). The first comes
from the class bigrams of all training texts under the final classes, by Witten-Bell
smoothing; the second is the word's share of its class; the shared class adds 0.5 to
each count and has room for one unseen word.

Words of at least some count, HEAD of them at most, go to the executors as a dictionary;
the limit is taken from a histogram of counts. Others meet their counts and classes in
a join and are put into their places of the text's path of classes, so the dictionary's size
has no influence on any result. Bigram counts on the driver are bounded by the square of
SEEDS + 3.

Null texts count as empty: one end token. A null doc_id counts as an empty text
for the folds. Each row is scored by itself, so repeated ids keep their rows. With no
training document all counts are zero. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, crc_mod, importable, slices, stage_table

SEEDS = 1000
#: Bounds of the number of classes; a class is one byte of a path, and OPEN a place to be filled.
LEAST, MOST, OPEN = 40, 200, 255
PASSES = 60
HEAD = 200_000
FLUSH = 400_000
#: Steps of the histogram of counts for each doubling.
FINE = 8


def tokens(text) -> list[bytes]:
    """Words of a text (a pyarrow string scalar's bytes), capital letters A-Z made small."""
    return text.lower().split()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and its count n over all rows."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for text in _texts(batch):
                seen.update(tokens(text))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_counts(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of neighbours: ids of words, then other words, the end, and the start of a text."""
    k = len(words)
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches):
        total = np.zeros((k + 3) ** 2, np.int64) if k else np.zeros(9, np.int64)
        get = shared.value.get
        for batch in slices(batches, "text"):
            ids = []
            for text in _texts(batch):
                ids.append(k + 2)
                ids.extend([get(w, k) for w in tokens(text)])
                ids.append(k + 1)
            a = np.array(ids, np.int64)
            pairs = a[:-1] * (k + 3) + a[1:]
            total += np.bincount(pairs[a[1:] != k + 2], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((k + 3) ** 2, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(k + 3, k + 3)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))  # of counts, so of whole numbers


def exchange(pairs: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Class of each id; the last three ids keep classes of their own."""
    k = len(pairs) - 3
    kinds = classes + 3
    own = np.concatenate([np.arange(k) % classes, classes + np.arange(3)])
    n = pairs.astype(float)
    one = np.eye(kinds)[own]
    grid = one.T @ n @ one
    for _ in range(passes):
        moved = 0
        for w in range(k):
            was = own[w]
            right = np.bincount(own, n[w], kinds)  # to the class of the next word
            left = np.bincount(own, n[:, w], kinds)
            same = n[w, w]
            right[was] -= same
            left[was] -= same
            # Without w:
            grid[was] -= right
            grid[:, was] -= left
            grid[was, was] -= same
            # The gain of putting w into class b, for all b at once.
            rows, cols = _xlogx(grid + right) - _xlogx(grid), _xlogx(grid.T + left) - _xlogx(grid.T)
            diag = np.diag(grid)
            gain = rows.sum(1) + cols.sum(1) - np.diag(rows) - np.diag(cols) + _xlogx(diag + right + left + same) - _xlogx(diag)
            # Without w's class, its neighbours' classes have w's counts all the same.
            before, after = grid.sum(1) + left, grid.sum(0) + right
            gain -= _xlogx(before + right.sum() + same) - _xlogx(before) + _xlogx(after + left.sum() + same) - _xlogx(after)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[was] + 1e-9:
                b = was
            moved += b != was
            own[w] = b
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += same
        if not moved:
            break
    return own


def transition_logs(grid: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) with Witten-Bell smoothing towards the class's own share."""
    kinds = len(grid)
    after = grid.sum(0) + 1e-3
    after[kinds - 1] = 0.0  # nothing leads to the start
    share = after / after.sum()
    total, types = grid.sum(1, keepdims=True), np.maximum((grid > 0).sum(1, keepdims=True), 1)
    return np.log10(np.maximum((grid + types * share) / (total + types), 1e-300))


def class_count(distinct: int) -> int:
    return min(MOST, max(LEAST, round(distinct ** (1 / 3))))


#: Counts of a context for which the change of each cell is held ready.
READY = 8


def changes(grid: np.ndarray, shared: int) -> list[np.ndarray]:
    """What 1 to READY more pairs change, by neighbour and class, for the next word and the one before."""
    return [np.stack([_xlogx(t + n) - _xlogx(t) for n in range(1, READY + 1)]) for t in (grid[:shared].T, grid[:, :shared])]


def gains(grid: np.ndarray, counts: np.ndarray, shared: int, ready: list[np.ndarray] | None = None) -> np.ndarray:
    """Gain in log likelihood of putting words of the shared class into each class before it, a row for each word.

    counts: a row for each word of how often the next word, then the word before, is of each class; grid: class bigrams.
    """
    kinds = len(grid)
    right, left = counts[:, :kinds], counts[:, kinds:]
    own_r, own_f = right[:, :shared], left[:, :shared]
    out = np.zeros((len(counts), shared))
    # Pairs with other classes than the shared one: only those that occur.
    for side, table, known in zip((right, left), (grid[:shared].T, grid[:, :shared]), ready or changes(grid, shared), strict=True):
        w, c = np.nonzero(side)
        w, c = w[c != shared], c[c != shared]
        if len(w):
            n = side[w, c].astype(np.int64)
            part = known[np.minimum(n, READY) - 1, c]
            many = n > READY
            part[many] = _xlogx(table[c[many]] + n[many, None]) - _xlogx(table[c[many]])
            begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            out[w[begin]] += np.add.reduceat(part, begin, axis=0)
    # Without the word, its neighbours' pairs with the shared class are fewer.
    for side, table, less in ((right, grid[:shared, shared], own_f), (left, grid[shared, :shared], own_r)):
        there = table - less
        out += _xlogx(there + side[:, shared, None]) - _xlogx(there)
    w, c = np.nonzero((own_r > 0) & (own_f > 0))
    diag, x, y = grid[c, c], own_r[w, c], own_f[w, c]
    out[w, c] += _xlogx(diag + x + y) - _xlogx(diag + x) - _xlogx(diag + y) + _xlogx(diag)
    before, after = grid.sum(1)[:shared], grid.sum(0)[:shared]
    out -= _xlogx(before + right.sum(1)[:, None]) - _xlogx(before)
    return out - (_xlogx(after + left.sum(1)[:, None]) - _xlogx(after))


_CONTEXT = np.dtype([("at", "<u2"), ("n", "<u4")])


def context_counts(docs: DataFrame, seeds: list[bytes], own: np.ndarray, classes: int) -> DataFrame:
    """word and contexts, one row for each word of a task: how often the next (at) or last (kinds + at) word is of class at."""
    kinds = classes + 3
    shared = docs.sparkSession.sparkContext.broadcast((dict(zip(seeds, own[: len(seeds)].tolist(), strict=True)), kinds))

    def run(batches):
        of, kinds = shared.value
        index: dict[bytes, int] = {}
        codes: list[np.ndarray] = []

        def out():
            code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
            names = pa.array(list(index), pa.binary())
            word = code // (2 * kinds)
            cells = np.zeros(len(code), _CONTEXT)
            cells["at"], cells["n"] = code % (2 * kinds), n
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            ends = np.append(begin, len(word))
            for k in range(0, len(begin), 100_000):
                own = ends[k : k + 100_001]
                offsets = ((own - own[0]) * _CONTEXT.itemsize).astype(np.int32)
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(cells[own[0] : own[-1]].tobytes())])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(word[own[:-1]])), blobs], names=["word", "contexts"])

        held = 0
        for batch in slices(batches, "text"):
            for text in _texts(batch):
                ws = tokens(text)
                kind = np.fromiter((of.get(w, classes) for w in ws), np.int64, len(ws))
                place = np.flatnonzero(kind == classes)
                if len(place):
                    word = np.fromiter((index.setdefault(ws[i], len(index)) for i in place.tolist()), np.int64, len(place)) * (2 * kinds)
                    around = np.concatenate([[classes + 2], kind, [classes + 1]])
                    codes += [word + around[place + 2], word + kinds + around[place]]
                    held += 2 * len(place)
            if len(index) > FLUSH or held > 4_000_000:
                yield from out()
                index, codes, held = {}, [], 0
        yield from out()

    return docs.select("text").mapInArrow(run, "word binary, contexts binary")


def assigned(contexts: DataFrame, grid: np.ndarray, classes: int) -> DataFrame:
    """word, n, class: the class with the largest gain, the first one of equals; the shared one for words that occur once."""
    kinds = classes + 3
    shared = contexts.sparkSession.sparkContext.broadcast(grid.astype(float))

    def run(batches):
        ready = changes(shared.value, classes)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                lists = part.column("contexts")
                blobs = lists.flatten().to_pylist()
                word = np.repeat(np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())), [len(x) // _CONTEXT.itemsize for x in blobs])
                cells = np.frombuffer(b"".join(blobs), _CONTEXT)
                counts = np.bincount(word * (2 * kinds) + cells["at"], cells["n"], part.num_rows * 2 * kinds).reshape(-1, 2 * kinds)
                n = counts[:, :kinds].sum(1).astype(np.int64)
                kind = np.full(part.num_rows, classes, np.int32)
                often = np.flatnonzero(n > 1)
                kind[often] = np.argmax(np.round(gains(shared.value, counts[often], classes, ready), 9), 1)
                yield pa.RecordBatch.from_arrays([part.column("word"), pa.array(n), pa.array(kind)], names=["word", "n", "class"])

    words = contexts.groupBy("word").agg(F.collect_list("contexts").alias("contexts"))
    return words.mapInArrow(run, "word binary, n bigint, class int")


def _bin(n="n"):
    return F.floor(F.log2(n) * FINE)


def fit_classes(train: DataFrame, seeds: int = SEEDS, classes: int | None = None) -> tuple[DataFrame, int, tuple[int, int]]:
    """The vocabulary (word, n, class; a staged table), the number of classes, and the numbers of word tokens and words."""
    passing = Staged()
    counts = passing.table(word_counts(train), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = classes or class_count(distinct)
    top = counts.orderBy(F.desc("n"), "word").limit(seeds).toArrow()
    words = top["word"].to_pylist()
    pairs = bigram_counts(train, words)
    own = exchange(pairs, classes)
    one = np.eye(classes + 3)[own]
    rest = assigned(context_counts(train, words, own, classes), one.T @ pairs @ one, classes)
    first = train.sparkSession.createDataFrame(list(zip(words, top["n"].to_pylist(), own[: len(words)].tolist(), strict=True)), "word binary, n bigint, class int")
    vocabulary = stage_table(first.unionByName(rest), "brown-words")
    passing.drop()
    return vocabulary, classes, (total, distinct)


def path_counts(filled: DataFrame, kinds: int) -> np.ndarray:
    """Class bigrams of the paths; only the counts of kinds x kinds pairs leave the executors."""

    def run(batches):
        total = np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                p = np.frombuffer(path, np.uint8).astype(np.int64)
                total += np.bincount(p[:-1] * kinds + p[1:], minlength=kinds * kinds)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    rows = filled.select("path").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(kinds * kinds)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(kinds, kinds)


def brown_scores(docs: DataFrame, folds: int = 5, held: int = 1, seeds: int = SEEDS, classes: int | None = None, head: int = HEAD) -> DataFrame:
    """One row for each document: see the module's text and the query's contract."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "text")
    train = rows.filter(~F.col("held_out"))
    n_docs = train.count()
    vocabulary, classes, (total, distinct) = fit_classes(train, seeds, classes)
    n_all, n_types = total + n_docs, distinct + (n_docs > 0)
    base_den = n_all + 0.5 * (n_types + 1)
    sizes = {r["class"]: (r.n, r.types) for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}
    rest_n, rest_types = sizes.get(classes, (0, 0))
    of_class = np.array([max(1, sizes.get(c, (0, 0))[0]) for c in range(classes)] + [rest_n + 0.5 * (rest_types + 1)])

    # The dictionary: all words from some bin of counts on.
    bins = sorted(((r.bin, r["count"]) for r in vocabulary.groupBy(_bin().alias("bin")).count().collect()), reverse=True)
    kept, least = 0, 1 << 30
    for b, c in bins:
        kept += c
        if kept > head:
            break
        least = b
    top = vocabulary.filter(_bin() >= least).toArrow()
    words, n_of, kind = top["word"].to_pylist(), top["n"].to_numpy(), top["class"].to_numpy()
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, np.append(n_of, 0).astype(float), np.append(kind, OPEN).astype(np.uint8), of_class))
    unseen, start, end = len(words), classes + 2, classes + 1
    end_base = math.log10((n_docs + 0.5) / base_den)

    def emitted(n: np.ndarray, kind: np.ndarray, of_class: np.ndarray) -> np.ndarray:
        return np.log10((n + np.where(kind == classes, 0.5, 0.0)) / of_class[kind])

    def run(batches):
        index, n_of, kind, of_class = shared.value
        get, at = index.get, TaskContext.get().partitionId() << 36
        base = np.log10((n_of + 0.5) / base_den)
        base[unseen] = 0.0
        emit = np.append(emitted(n_of[:unseen], kind[:unseen], of_class), 0.0)
        for batch in slices(batches, "text"):
            keys, lengths, known, bases, scores, paths, rest = [], [], [], [], [], [], []
            for text in _texts(batch):
                ws = tokens(text)
                ids = np.fromiter((get(w, unseen) for w in ws), np.int64, len(ws))
                keys.append(at)
                at += 1
                lengths.append(len(ws) + 1)
                out = np.flatnonzero(ids == unseen)
                known.append(len(ws) - len(out) + (n_docs > 0))
                bases.append(float(base[ids].sum()) + end_base)
                scores.append(float(emit[ids].sum()))
                paths.append(bytes([start]) + kind[ids].tobytes() + bytes([end]))
                places: dict[bytes, list[int]] = {}
                for i in out.tolist():
                    places.setdefault(ws[i], []).append(i + 1)
                rest.append([{"word": w, "places": np.array(p, "<i4").tobytes()} for w, p in places.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(keys, pa.int64()), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64()), pa.array(paths, pa.binary()),
                 pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("places", pa.binary())])))],
                names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "path", "rest"],
            )

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base_score double, score double, path binary, rest array<struct<word: binary, places: binary>>"
    passing = Staged()
    local = passing.table(rows.mapInArrow(run, kinds), "brown-local")
    # Words beyond the dictionary meet their counts and classes here, a document's equal words at once.
    tail = vocabulary.filter(_bin() < least).select("word", F.col("n").alias("c"), "class")
    met = (
        local.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.places")
        .join(tail, "word", "left")
        .groupBy("row")
        .agg(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(classes)).alias("class"), "places")).alias("more"))
    )

    def fill(batches):
        of_class = shared.value[3]
        for batch in batches:
            paths, lists = batch.column("path").to_pylist(), batch.column("more")
            size = np.array([len(p) for p in paths], np.int64)
            start = np.cumsum(size) - size
            whole = np.frombuffer(b"".join(paths), np.uint8).copy()
            more = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).fill_null(0).to_numpy())
            c, kind = (more.field(k).to_numpy() for k in (0, 1))
            blobs = more.field(2).to_pylist()
            times = np.array([len(x) // 4 for x in blobs], np.int64)
            whole[np.repeat(start[row], times) + np.frombuffer(b"".join(blobs), "<i4")] = np.repeat(kind, times)
            added = lambda x, of=row, n=batch.num_rows: np.bincount(of, x, n)
            known = batch.column("n_known").to_numpy() + added(times * (c > 0)).astype(np.int64)
            base = batch.column("base_score").to_numpy() + added(times * np.log10((c + 0.5) / base_den))
            score = batch.column("score").to_numpy() + added(times * emitted(c.astype(float), kind, of_class))
            filled_paths = [whole[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens")), pa.array(known), pa.array(base), pa.array(score), pa.array(filled_paths, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "path"])

    plain = kinds.replace(" row bigint,", "").rpartition(", rest")[0]
    filled = stage_table(local.drop("rest").join(met, "row", "left").mapInArrow(fill, plain), "brown-paths")
    passing.drop()
    moves = spark.sparkContext.broadcast(transition_logs(path_counts(filled.filter("not held_out"), classes + 3)))

    def finish(batches):
        for batch in batches:
            more = [float(moves.value[p[:-1], p[1:]].sum()) for p in (np.frombuffer(x, np.uint8) for x in batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.array(batch.column("score").to_pylist()) + np.array(more), pa.float64())], names=batch.schema.names[:-1])

    scored = filled.mapInArrow(finish, plain.rpartition(", path")[0])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
