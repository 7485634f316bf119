"""Quality scores by positive-unlabelled learning.

A small neural network on dense features of the whole text is trained on the
driver, on the feature vectors of at most FIT_ROWS trusted positives (quality 1,
training fold) and FIT_ROWS unlabelled documents, the first ones by a hash of
doc_id. It minimises the non-negative unbiased risk: prior * E_p[loss(+)] +
max(0, E_u[loss(-)] - prior * E_p[loss(-)]). The class prior is estimated first:
a scorer that tells positives from unlabelled rows is fitted to one half of each,
and on the other half the least ratio between the shares of unlabelled and of
positive rows above a cut bounds it. Labels of other quality are not used.

Null texts count as empty. A null doc_id is never trained on. Repeated rows are
scored alike; a document with labels of both kinds is no trusted positive.
Without any trusted positives or unlabelled rows every score is 1 (nothing is known against a
text). Extra columns are dropped.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, map_text
from tidemark.llm.toxicity import labelled_sample

FIT_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, STEP = 24, 40, 512, 0.01
SLACK = 1.5
NAMES = ("words", "length", "symbols", "bangs", "bars", "capitals", "digits", "distinct", "top_word", "dup_lines", "line", "stops", "packed", "long", "repeats", "few")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text: str) -> list[float]:
    words = WORD.findall(text)
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    raw = text.encode("utf-8", "replace")
    return [
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        min(2.0, sum(map(text.count, "#*$%&<>")) / n),
        min(2.0, text.count("!") / n),
        min(2.0, text.count("|") / n),
        sum(map(str.isupper, text)) / size,
        sum(map(text.count, "0123456789")) / size,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        sum(map(text.count, ".,;:")) / n,
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        sum(len(w) > 20 for w in words) / n,
        sum(c for c in windows.values() if c > 1) / n,
        float(len(words) < 50),
    ]


class Net:
    """One hidden layer, trained with Adam; `steps` gives the gradient of the loss by the output."""

    def __init__(self, x: np.ndarray, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        d = x.shape[1]
        self.parts = [rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.m = [np.zeros_like(p) for p in self.parts]
        self.v = [np.zeros_like(p) for p in self.parts]
        self.t = 0

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def out(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.parts[0] + self.parts[1], 0) @ self.parts[2] + self.parts[3][0]

    def step(self, z: np.ndarray, slope: np.ndarray, rate: float) -> None:
        h = np.maximum(z @ self.parts[0] + self.parts[1], 0)
        back = np.outer(slope, self.parts[2]) * (h > 0)
        grads = [z.T @ back + 1e-4 * self.parts[0], back.sum(0), h.T @ slope + 1e-4 * self.parts[2], np.array([slope.sum()])]
        self.t += 1
        for p, g, m, v in zip(self.parts, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _train(net: Net, p: np.ndarray, u: np.ndarray, prior: float | None, seed: int = 1) -> Net:
    """Without a prior: positives against unlabelled rows; with one: the non-negative risk."""
    rng = np.random.default_rng(seed)
    half = BATCH // 2
    for epoch in range(EPOCHS):
        a, b = rng.permutation(len(p)), rng.permutation(len(u))
        rate = STEP * (1 - epoch / EPOCHS)
        for k in range(max(1, max(len(p), len(u)) // half)):
            i, j = (np.take(x, range(k * half, (k + 1) * half), mode="wrap") for x in (a, b))
            zp, zu = p[i], u[j]
            fp, fu = net.out(zp), net.out(zu)
            sp, su = _sigmoid(fp), _sigmoid(fu)
            if prior is None:
                slope = np.concatenate([(sp - 1) / len(i), su / len(j)])
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                if negative >= 0:
                    slope = np.concatenate([(prior * (sp - 1) - prior * sp) / len(i), su / len(j)])
                else:  # only the part that went below zero is undone
                    slope = np.concatenate([prior * sp / len(i), -su / len(j)])
            net.step(np.concatenate([zp, zu]), slope, rate)
    return net


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from the best cut of a scorer on rows it hasn't seen."""
    net = Net(np.concatenate([p, u]))
    zp, zu = net.prepare(p), net.prepare(u)
    _train(net, zp[::2], zu[::2], None)
    fp, fu = np.sort(net.out(zp[1::2])), np.sort(net.out(zu[1::2]))
    cuts = np.quantile(fp, np.linspace(0, 0.9, 91))
    above_p = 1 - np.searchsorted(fp, cuts, "left") / len(fp)
    above_u = 1 - np.searchsorted(fu, cuts, "left") / len(fu)
    slack = SLACK * math.sqrt(1 / len(fp) + 1 / len(fu))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.05, 0.99))


class Model:
    def __init__(self, p: np.ndarray, u: np.ndarray) -> None:
        self.net = None
        if len(p) >= 20 and len(u) >= 20:
            self.prior = estimate_prior(p, u)
            net = Net(np.concatenate([p, u]), seed=2)
            self.net = _train(net, net.prepare(p), net.prepare(u), self.prior)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None or not texts:
            return np.ones(len(texts))
        return _sigmoid(self.net.out(self.net.prepare(np.array([features(t) for t in texts]))))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = FIT_ROWS) -> Model:
    trusted = labels.filter(crc_mod("doc_id", folds) != held).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("label")).filter("low = 1 and label = 1").select("doc_id", "label")
    rest = docs.select("doc_id").filter(crc_mod("doc_id", folds) != held).join(labels.select("doc_id"), "doc_id", "left_anti").distinct().withColumn("label", F.lit(0))

    def vectors(ids: DataFrame) -> np.ndarray:
        into = "_x"
        sample = map_text(labelled_sample(docs, ids, rows), lambda texts: pa.array([features(t) for t in texts], pa.list_(pa.float64())), "array<double>", into)
        found = sample.select(into, F.xxhash64("doc_id").alias("h")).orderBy("h").toArrow()
        return np.array(found[into].to_pylist(), float).reshape(-1, len(NAMES))

    return Model(vectors(trusted), vectors(rest))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held, rows))
    into = "_score"
    out = map_text(docs.select("doc_id", "text"), lambda texts: pa.array(model.value.score(texts), pa.float64()), "double", into)
    return out.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), F.col(into).alias("score"), (F.col(into) >= cut).cast("int").alias("predicted"))
