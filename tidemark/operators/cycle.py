"""Business-cycle calendar: monthly and quarterly recession flags, growth and the technical rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Months of peak and trough.
CYCLES = [
    ("1948-11-01", "1949-10-01"), ("1953-07-01", "1954-05-01"), ("1957-08-01", "1958-04-01"), ("1960-04-01", "1961-02-01"),
    ("1969-12-01", "1970-11-01"), ("1973-11-01", "1975-03-01"), ("1980-01-01", "1980-07-01"), ("1981-07-01", "1982-11-01"),
    ("1990-07-01", "1991-03-01"), ("2001-03-01", "2001-11-01"), ("2007-12-01", "2009-06-01"), ("2020-02-01", "2020-04-01"),
]


def calendar(spark: SparkSession, first: str = "1948-01-01", last: str = "2014-12-01", peak_counts: bool = False) -> DataFrame:
    """One row a quarter: months in recession, majority and any flags. The cycles are a dozen rows, so they are broadcast."""
    cycles = spark.createDataFrame(CYCLES, "peak string, trough string").select(F.add_months(F.to_date("peak"), 0 if peak_counts else 1).alias("begin"), F.to_date("trough").alias("trough"))
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("month"))
    hits = months.join(F.broadcast(cycles), F.col("month").between(F.col("begin"), F.col("trough")), "left")
    monthly = hits.groupBy("month").agg(F.bool_or(F.col("begin").isNotNull()).alias("recession"))
    yq = F.concat(F.year("month").cast("string"), F.lit("Q"), F.quarter("month").cast("string"))
    n = F.sum(F.col("recession").cast("int"))
    return monthly.groupBy(yq.alias("yq")).agg(n.cast("long").alias("recession_months"), (n >= 2).alias("recession_majority"), (n >= 1).alias("recession_any"))


def growth(series: DataFrame, value: str = "value", key: str = "yq") -> DataFrame:
    """Percentage change on the quarter before, and the technical rule: two falls in a row."""
    w = W.orderBy(key)
    g = F.col("growth")
    return (
        series.withColumn("growth", 100 * (F.try_divide(F.col(value), F.lag(value).over(w)) - 1))
        .withColumn("falls", F.coalesce(g < 0, F.lit(False)))
        .withColumn("technical", F.col("falls") & F.coalesce(F.lag("falls").over(w), F.lit(False)))
        .drop("falls")
    )


def agreement(calendar: DataFrame, rule: DataFrame) -> DataFrame:
    """How often the technical rule agrees with, misses or adds to the majority flag, where both exist."""
    both = rule.filter("growth is not null").join(calendar, "yq")
    a, b = F.col("recession_majority"), F.col("technical")
    return both.agg(F.count_if(a == b).alias("agree"), F.count_if(a & ~b).alias("missed"), F.count_if(~a & b).alias("added"))
