"""Samples in the order of a hash, equal on every engine; the caps here are the operator itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hash_order(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def simple_sample(rows: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    return rows.orderBy(hash_order(seed, key), key).limit(n)


def lowest(rows: DataFrame, cell: list[str], order: list[Column], most: int) -> DataFrame:
    """rows with their `rank` in the cell, the first `most` of each cell only.

    `most` is a literal in the filter, so every task keeps at most so many rows of a cell before anything is
    shuffled, and the task that ends a cell sorts that many from each, however large the cell is.
    """
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*cell).orderBy(*order))).filter(F.col("rank") <= most)


def stratified(rows: DataFrame, quotas: dict[int, dict[str, int]], seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """Up to a quota of rows of each (decade, stratum), with the weight population / drawn; quotas by decade and stratum.

    A cell without a quota gives none.
    """
    if exclude is not None:
        rows = rows.join(exclude.select("row_id").distinct(), "row_id", "left_anti")
    cells = [(d, s, n) for d, own in quotas.items() for s, n in own.items()]
    allowed = rows.sparkSession.createDataFrame(cells, "decade long, stratum string, quota int")
    sizes = rows.groupBy("decade", "stratum").agg(F.count("*").alias("population"))
    ranked = lowest(rows.select("row_id", "decade", "stratum"), ["decade", "stratum"], [hash_order(seed, "row_id"), F.col("row_id")], max(n for *_, n in cells))
    drawn = ranked.join(F.broadcast(allowed), ["decade", "stratum"]).filter("rank <= quota").join(F.broadcast(sizes), ["decade", "stratum"])
    return drawn.withColumn("weight", F.col("population") / F.least("quota", "population")).select("row_id", "decade", "stratum", "population", "weight")


def audit(hits: DataFrame, rules: list[str], per_rule: int, seed: int, exclude: DataFrame) -> DataFrame:
    """Up to per_rule rows hit by each rule that aren't in exclude."""
    free = hits.join(exclude.select("row_id").distinct(), "row_id", "left_anti")
    long = free.select("row_id", F.explode(F.array(*[F.when(F.col(f"rule_{r}"), F.lit(r)) for r in rules])).alias("rule")).filter("rule is not null")
    return lowest(long, ["rule"], [hash_order(seed, "rule", "row_id"), F.col("row_id")], per_rule).select("rule", "row_id")
