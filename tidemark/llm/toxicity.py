"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: density of a fixed lexicon and of one of words and word
beginnings learnt from the training fold, hits that need letters put back for signs (obfuscation), hits near a word for
the reader, capitals, punctuation, stretched letters. The trees and the isotonic
curve are fitted on the driver to the feature vectors of at most FIT_ROWS
labelled rows, the first ones by a hash of doc_id, of the training fold only; a
quarter of these rows is kept for the curve, and neither words nor trees are learnt from it. Whole texts are read.

Null texts count as empty and get a score as any other. A null doc_id is never
trained on. Repeated rows are scored alike; repeated labels count as toxic
if any of them is. Without labels of both kinds all scores are the share of
toxic labels (0 if there is none). Extra columns are dropped.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, fresh, map_text, slices, stage_table

FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
LEARNT = 200
#: How many times as frequent among toxic documents a learnt word is at least.
LIFT = 8.0

LEXICON = frozenset(
    "idiot idiots moron morons stupid pathetic loser losers scum trash worthless clown clowns disgusting dumb fool fools garbage jerk "
    "imbecile retard cretin filth filthy vermin parasite hate hateful ugly useless liar coward creep freak pig swine rat shut kill die "
    "dumm idiotin abschaum verlierer widerlich wertlos imbécile crétin nul stupide idiote ordure estúpido imbécil basura inútil asqueroso".split()
)
READER = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta tú ti usted ustedes vosotros".split())
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: What may stand around a word that has signs or digits between its letters.
AROUND = ".,;:!?\"'()[]{}<>«»„“”-*_|"
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})
STRETCHED = re.compile(r"([^\W\d_])\1\1")
NAMES = ("lexicon", "hits", "kinds", "masked", "reader", "near", "capitals", "shouted", "bangs", "asks", "marks", "digits", "stretched", "length", "words", "learnt", "learnt_hits")
#: Lengths of the word beginnings that are learnt beside whole words, for compounds and endings.
STEMS = (4, 5, 6)


def features(text: str, learnt: dict[str, float]) -> list[float]:
    low = text.lower()
    words = WORDS.findall(low)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in LEXICON]
    reader = [i for i, w in enumerate(words) if w in READER]
    near = 0
    if hits and reader:
        at = np.searchsorted(reader, hits)
        r = np.array([-(10**9), *reader, 10**9])
        near = int((np.minimum(np.array(hits) - r[at], r[at + 1] - np.array(hits)) <= 5).sum())
    masked = 0
    for part in low.split():
        if not part.isalpha() and not (part := part.strip(AROUND)).isalpha() and len(part) > 2:
            plain = part.translate(SIGNS)
            masked += plain in LEXICON or STRETCHED.sub(r"\1", plain) in LEXICON
    stretched = STRETCHED.findall(low)
    size = max(1, len(text))
    return [
        100 * len(hits) / n,
        math.log1p(len(hits)),
        len({words[i] for i in hits}),
        math.log1p(masked),
        100 * len(reader) / n,
        near / max(1, len(hits)),
        sum(map(str.isupper, text)) / size,
        0.0 if text == low else sum(w.isupper() for w in text.split()) / n,
        text.count("!") / n,
        text.count("?") / n,
        sum(map(text.count, ".,;:\"'()")) / size,
        sum(map(text.count, "0123456789")) / size,
        len(stretched) / n,
        sum(map(len, words)) / n,
        math.log1p(len(words)),
        *_learnt(words, learnt),
    ]


def _keys(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in STEMS if len(word) >= k]]


def _learnt(words: list[str], learnt: dict[str, float]) -> tuple[float, float]:
    """Density of the learnt log odds, and the number of words that have any."""
    if not learnt:
        return 0.0, 0.0
    of: dict[str, float] = {}
    total, hits = 0.0, 0
    for w in words:
        v = of.get(w)
        if v is None:
            v = of[w] = max(learnt.get(k, 0.0) for k in _keys(w))
        if v:
            total += v
            hits += 1
    return total * 100 / max(1, len(words)), math.log1p(hits)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and beginnings whose share of toxic documents is clearly above that of others, with their log odds; at most LEARNT."""

    def run(batches):
        seen: dict[str, list[int]] = {}
        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for w in {k for w in set(WORDS.findall((text or "").lower())) for k in _keys(w)}:
                    seen.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["word", "calm", "toxic"])

    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {}
    counts = sample.select("text", "label").mapInArrow(run, "word string, calm bigint, toxic bigint").groupBy("word").agg(F.sum("calm").alias("calm"), F.sum("toxic").alias("toxic"))
    odds = F.log(F.col("toxic") / totals[1]) - F.log((F.col("calm") + 1) / (totals[0] + 2.0))
    top = counts.filter("toxic >= 5").withColumn("odds", odds).filter(f"odds > {math.log(LIFT)}").orderBy(F.desc(F.col("toxic") * F.col("odds")), "word").limit(LEARNT)
    return {r.word: r.odds for r in top.collect()}


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bins(x)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        self.trees: list[list[tuple[int, int, int, int, float]]] = []
        f = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree: list[tuple[int, int, int, int, float]] = []
            f += RATE * self._grow(tree, binned, p - y, p * (1 - p), np.arange(len(y)), DEPTH, len(y))
            self.trees.append(tree)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int16)

    def _grow(self, tree, binned, g, h, rows, depth, size) -> np.ndarray:
        """Appends a node (feature, bin, left, right, value) and gives the values of its rows, 0 elsewhere."""
        at = len(tree)
        value = float(-g[rows].sum() / (h[rows].sum() + 1.0))
        tree.append((-1, 0, 0, 0, value))
        best, split = 1e-3, None
        if depth and len(rows) >= 20:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j in range(binned.shape[1]):
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, BINS + 1)) for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                gain[(nl < 8) | (nl > len(rows) - 8)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, split = gain[k], (j, k)
        out = np.zeros(size)
        if split is None:
            out[rows] = value
            return out
        j, k = split
        left = binned[rows, j] <= k
        a = len(tree)
        out += self._grow(tree, binned, g, h, rows[left], depth - 1, size)
        b = len(tree)
        out += self._grow(tree, binned, g, h, rows[~left], depth - 1, size)
        tree[at] = (j, k, a, b, value)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, f = self._bins(x), np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                go = binned[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            f += RATE * value[at]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step curve nearest to y (pool adjacent violators), joined by lines when used."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    # Half an observation towards the mean keeps the ends off 0 and 1.
    mean = float(y.mean())
    knots = [(e, (s + 0.5 * mean) / (w + 0.5)) for s, w, lo, hi in blocks for e in (lo, hi)]
    return np.array([k for k, _ in knots]), np.maximum.accumulate([v for _, v in knots])


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, learnt: dict[str, float]) -> None:
        self.learnt, self.trees = learnt, None
        self.share = float(y.mean()) if len(y) else 0.0
        if len(set(y[~keep])) == 2 and len(set(y[keep])) == 2:
            self.trees = Trees(x[~keep], y[~keep])
            self.curve = isotonic(self.trees.raw(x[keep]), y[keep])

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.trees or not texts:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(np.array([features(t, self.learnt) for t in texts]))
        # A small share of the raw score keeps the order inside the curve's flat parts.
        return 0.999 * np.interp(raw, *self.curve) + 0.001 / (1 + np.exp(-raw))


def labelled_sample(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """Text and label of the first `rows` ids by hash, one row each; ids: doc_id, label, at most `rows` of which are broadcast.

    An id that repeats with several texts counts with the least of them.
    """
    first = ids.filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(first.hint("broadcast")), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = FIT_ROWS) -> Model:
    known = labels.filter(F.col("toxic").isNotNull() & (crc_mod("doc_id", folds) != held))
    ids = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    keep = (crc_mod("doc_id", folds * 4) / folds).cast("int") % 4 == 0
    sample = stage_table(labelled_sample(docs, ids, rows).withColumn("keep", keep), "toxic-sample")
    # The rows for the curve give the trees no words either, so the curve sees scores as of unknown documents.
    learnt = learn_lexicon(sample.filter("not keep"))

    def function(texts: list[str]) -> pa.Array:
        return pa.array([features(t, learnt) for t in texts], pa.list_(pa.float64()))

    into = fresh(sample, "_x")
    table = map_text(sample, function, "array<double>", into).select(into, "label", "keep", F.xxhash64("doc_id").alias("h")).orderBy("h").toArrow()
    x = np.array(table[into].to_pylist(), float).reshape(-1, len(NAMES))
    return Model(x, np.array(table["label"].to_pylist(), float), np.array(table["keep"].to_pylist(), bool), learnt)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held, rows))
    into = "_score"
    out = map_text(docs.select("doc_id", "text"), lambda texts: pa.array(model.value.score(texts), pa.float64()), "double", into)
    return out.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), F.col(into).alias("score"), (F.col(into) >= cut).cast("int").alias("predicted"))
