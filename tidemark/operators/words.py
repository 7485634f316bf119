"""Word contrasts: counts by group, weighted log-odds with a Dirichlet prior, permutation thresholds, concentration."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import contrast_tokens


#: Words of one block of a task, so that its tables of words by shuffles stay small.
WORDS = 500


def word_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word, n. Partial sums before the shuffle keep frequent words cheap."""
    return records.select(*keys, F.explode(contrast_tokens(F.col("text"))).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def log_odds(counts: DataFrame, least: int = 50, prior: float = 1000.0) -> DataFrame:
    """word, delta, z: counts (decade, recession, word, n) of decades with both states, pooled by inverse variance.

    The prior is `prior` times a word's share of all words; words below `least` in all make up totals only.
    """
    total = counts.groupBy("word").agg(F.sum("n").alias("n_w"))
    grand = counts.agg(F.sum("n")).first()[0] or 1
    vocab = total.filter(F.col("n_w") >= least).select("word", (F.lit(float(prior)) * F.col("n_w") / grand).alias("alpha"))
    state = lambda s: F.coalesce(F.sum(F.when(F.col("recession") == s, F.col("n"))), F.lit(0))
    sides = counts.groupBy("decade").agg(state(True).alias("n_r"), state(False).alias("n_e")).filter("n_r > 0 and n_e > 0")
    seen = counts.groupBy("decade", "word").agg(state(True).alias("y_r"), state(False).alias("y_e"))
    # Each word meets each decade (a handful), with zero counts where it wasn't seen.
    spine = vocab.withColumn("decade", F.explode(F.lit([r.decade for r in sides.select("decade").collect()])))
    cells = spine.join(seen, ["decade", "word"], "left").join(F.broadcast(sides), "decade").fillna(0, ["y_r", "y_e"])
    a, big = F.col("alpha"), F.lit(float(prior))
    side = lambda y, n: F.log((F.col(y) + a) / (F.col(n) + big - F.col(y) - a))
    var = 1 / (F.col("y_r") + a) + 1 / (F.col("y_e") + a)
    parts = cells.select("word", (side("y_r", "n_r") - side("y_e", "n_e")).alias("d"), var.alias("v"))
    out = parts.groupBy("word").agg((F.sum(F.col("d") / F.col("v")) / F.sum(1 / F.col("v"))).alias("delta"), F.sum(1 / F.col("v")).alias("w"))
    return out.select("word", "delta", (F.col("delta") * F.sqrt("w")).alias("z"))


def shuffled_labels(quarters: list[tuple[str, int, bool]], times: int, seed: int) -> np.ndarray:
    """times x quarters: within each decade as many recession quarters as there are, the first ones by a hash."""
    out = np.zeros((times, len(quarters)), bool)
    decades: dict[int, list[int]] = {}
    for i, (_, decade, _) in enumerate(quarters):
        decades.setdefault(decade, []).append(i)
    for b in range(times):
        for own in decades.values():
            k = sum(quarters[i][2] for i in own)
            order = sorted(own, key=lambda i: (hashlib.md5(f"{seed}:{b}:{quarters[i][0]}".encode()).hexdigest(), quarters[i][0]))
            out[b, order[:k]] = True
    return out


def permutation_max(counts: DataFrame, times: int = 500, seed: int = 42, least: int = 50, prior: float = 1000.0) -> DataFrame:
    """perm, max_z: the largest absolute z of any word for each shuffle of the quarters' labels (perm -1: as observed).

    counts: yq, decade, recession, word, n. Words are dealt to blocks; a block is a matrix of words by
    quarters, multiplied with all labels at once, and sends one maximum for each shuffle.
    """
    spark = counts.sparkSession
    quarters = sorted((r.yq, r.decade, r.recession) for r in counts.select("yq", "decade", "recession").distinct().collect())
    labels = np.vstack([[q[2] for q in quarters], shuffled_labels(quarters, times, seed)]).astype(float)
    decades = sorted({q[1] for q in quarters})
    member = np.array([[q[1] == d for q in quarters] for d in decades], float)
    place = {q[0]: i for i, q in enumerate(quarters)}
    by_quarter = {r.yq: r.n for r in counts.groupBy("yq").agg(F.sum("n").alias("n")).collect()}
    size = np.array([by_quarter[q[0]] for q in quarters], float)
    grand = size.sum()
    totals = (labels * size) @ member.T, ((1 - labels) * size) @ member.T  # shuffles x decades
    shared = spark.sparkContext.broadcast((labels, member, totals, place))

    def run(batches):
        labels, member, (n_r, n_e), place = shared.value
        best = np.zeros(len(labels))
        for batch in (b.slice(i, WORDS) for b in batches for i in range(0, b.num_rows, WORDS)):
            # The cells stay in their columns; as objects of Python they would take hundreds of times as much.
            cells = batch.column("cells")
            flat = cells.flatten()
            yq = flat.field("yq").dictionary_encode()
            column = np.array([place[q] for q in yq.dictionary.to_pylist()], np.int64)[yq.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(cells).to_numpy(zero_copy_only=False))
            y = np.zeros((batch.num_rows, len(place)))
            y[row, column] = flat.field("n").to_numpy(zero_copy_only=False)
            alpha = prior * y.sum(1) / grand
            top, weight = np.zeros((batch.num_rows, len(labels))), np.zeros((batch.num_rows, len(labels)))
            for d in range(len(member)):
                own = member[d] > 0
                yr, ye = y[:, own] @ labels[:, own].T, y[:, own] @ (1 - labels[:, own]).T
                use = (n_r[:, d] > 0) & (n_e[:, d] > 0)
                a = alpha[:, None]
                delta = np.log((yr + a) / np.where(use, n_r[:, d] + prior - yr - a, 1.0)) - np.log((ye + a) / np.where(use, n_e[:, d] + prior - ye - a, 1.0))
                w = 1 / (1 / (yr + a) + 1 / (ye + a))
                top += np.where(use, delta * w, 0.0)
                weight += np.where(use, w, 0.0)
            best = np.maximum(best, np.abs(top / np.sqrt(np.maximum(weight, 1e-300))).max(0, initial=0.0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(best) - 1), pa.int64()), pa.array(best)], names=["perm", "max_z"])

    words = counts.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("yq", "n")).alias("cells")).filter(F.col("n") >= least)
    return words.select("cells").mapInArrow(run, "perm bigint, max_z double").groupBy("perm").agg(F.max("max_z").alias("max_z"))


def threshold(maxima: DataFrame, level: float = 0.95) -> DataFrame:
    return maxima.filter("perm >= 0").agg(F.percentile("max_z", F.lit(level)).alias("threshold"))


def concentration(counts: DataFrame, key: str = "yq") -> DataFrame:
    """For each quarter the most frequent word (the first one by letters on ties), its count and share."""
    top = F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("top_word")
    return counts.groupBy(key).agg(top, F.max("n").alias("top_count"), F.sum("n").alias("words")).withColumn("top_share", F.col("top_count") / F.col("words"))


def vocabulary(token_rows: DataFrame, min_df: int = 20, max_df: float = 0.5, size: int = 5000) -> DataFrame:
    """word, df, tf, index: words in min_df records or more and at most max_df of them, the `size` most frequent ones in all."""
    n_docs = token_rows.select(F.countDistinct("row_id")).first()[0]
    stats = token_rows.groupBy("row_id", "word").agg(F.count("*").alias("n")).groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    top = stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).orderBy(F.desc("tf"), "word").limit(size)
    return top.select("word", "df", "tf", (F.row_number().over(W.orderBy("word")) - 1).cast("long").alias("index"))
