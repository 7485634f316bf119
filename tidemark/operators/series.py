"""Quarterly series and what is read off them: gaps, normalised effects, comparisons, composition, shift-share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def macro(scores: DataFrame, outcomes: list[str], key: str = "yq") -> DataFrame:
    """Mean over records of count / words, in percent, without records that have no words."""
    return scores.filter("total_words > 0").groupBy(key).agg(*[(100 * F.avg(F.col(o) / F.col("total_words"))).alias(o) for o in outcomes], F.count("*").alias("ads"))


def pooled(scores: DataFrame, outcomes: list[str], key: str = "yq") -> DataFrame:
    """Sum of counts / sum of words, in percent."""
    return scores.filter("total_words > 0").groupBy(key).agg(*[(100 * F.sum(o) / F.sum("total_words")).alias(o) for o in outcomes], F.count("*").alias("ads"))


def long_panel(series: DataFrame, outcomes: list[str], **labels: str) -> DataFrame:
    """One row for each quarter and outcome: yq, outcome, y and constant labels."""
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y")) for o in outcomes])).alias("r")
    return series.select("yq", rows).select("yq", "r.outcome", "r.y", *[F.lit(v).alias(k) for k, v in labels.items()])


def gaps(panel: DataFrame, by: list[str], state: Column) -> DataFrame:
    """Difference of the group means, their mean as the level, and the effect in percent of it."""
    rec, exp = F.avg(F.when(state, F.col("y"))), F.avg(F.when(~state, F.col("y")))
    out = panel.groupBy(*by).agg(rec.alias("mean_recession"), exp.alias("mean_expansion"), F.avg("y").alias("mean_y"))
    gap = F.col("mean_recession") - F.col("mean_expansion")
    return out.withColumns({"gap": gap, "pct_of_level": 100 * gap / ((F.col("mean_recession") + F.col("mean_expansion")) / 2), "pct_of_mean": 100 * gap / F.col("mean_y")})


def columns_by_suffix(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def reproduced(candidates: DataFrame, names: list[str], stored: DataFrame, key: str = "yq", value: str = "value", tolerance: float = 1e-6) -> DataFrame:
    """candidate, max_error, points, chosen: which of the columns `names` gives a stored series again.

    All columns are held against it in one pass. A column is chosen if it has every point of the series (and no
    other) with an error below the tolerance; reading the result fails unless exactly one is chosen.
    """
    both = candidates.select(key, *names).join(stored.select(key, F.col(value).alias("_stored")), key, "full")
    miss = lambda c: F.col(c).isNull() != F.col("_stored").isNull()
    error = lambda c: F.max(F.when(miss(c), F.lit(float("inf"))).otherwise(F.abs(F.col(c) - F.col("_stored"))))
    parts = both.agg(*[F.struct(F.lit(c).alias("candidate"), error(c).alias("max_error"), F.count_if(F.col(c).isNotNull() & F.col("_stored").isNotNull()).alias("points")).alias(f"_{i}") for i, c in enumerate(names)])
    found = parts.select(F.array(*[f"_{i}" for i in range(len(names))]).alias("c"))
    good = lambda x: (x["max_error"] < tolerance) & (x["points"] > 0)
    winners = F.size(F.filter("c", good))
    said = F.concat(winners.cast("string"), F.lit(" columns give the stored series again; one was wanted"))
    checked = found.withColumn("c", F.when(winners == 1, F.col("c")).otherwise(F.raise_error(said).cast(found.schema["c"].dataType)))
    return checked.select(F.explode("c").alias("x")).select("x.*", F.coalesce(good(F.col("x")), F.lit(False)).alias("chosen"))


def shift_share(rows: DataFrame) -> DataFrame:
    """rows: decade, sector, state (boolean), y. Between and within parts for each decade that has both states."""
    cells = rows.groupBy("decade", "sector").agg(*[f for s, c in (("r", F.col("state")), ("e", ~F.col("state"))) for f in (F.count_if(c).alias(f"n_{s}"), F.avg(F.when(c, F.col("y"))).alias(f"m_{s}"))])
    totals = rows.groupBy("decade").agg(F.count_if("state").alias("t_r"), F.count_if(~F.col("state")).alias("t_e"))
    both = cells.join(totals.filter("t_r > 0 and t_e > 0"), "decade")
    wr, we = F.col("n_r") / F.col("t_r"), F.col("n_e") / F.col("t_e")
    # A sector that one state lacks borrows the other state's mean.
    mr, me = F.coalesce("m_r", "m_e"), F.coalesce("m_e", "m_r")
    parts = both.groupBy("decade").agg(F.max("t_r").alias("recession_ads"), F.sum((wr - we) * (mr + me) / 2).alias("between"), F.sum((wr + we) / 2 * (mr - me)).alias("within"))
    return parts.withColumn("total", F.col("between") + F.col("within"))


def pooled_shift_share(parts: DataFrame, least: float = 0.005) -> DataFrame:
    """Decade parts weighted by recession records; the mix share is left out for a total near zero."""
    w = F.col("recession_ads")
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    out = parts.agg(mean("between").alias("between"), mean("within").alias("within"), mean("total").alias("total"))
    return out.withColumn("mix_share", F.when(F.abs("total") >= least, F.col("between") / F.col("total")))
