"""Table readers, typed text readers and sinks, and the adapter that gives documents the shape of dated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shape of a raw record file; texts may hold line feeds and quotes.
RECORDS = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("issue_date", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("is_generic", T.BooleanType()), T.StructField("text", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RECORDS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """An export of a small result as one file; large tables go to Parquet."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def checked(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; an input that is a stub or another table is refused before any job runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"input lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidates that df has."""
    return next(c for c in candidates if c in df.columns)


def parsed_dates(df: DataFrame, column: str = "issue_date") -> DataFrame:
    """Text dates as DATE; what is no date becomes null."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column)).cast("date"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as dated records: row_id, brand, issue_date, text, year, yq, decade."""
    docs = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("1972-01-01").cast("date"), F.pmod(F.col("doc_id") * 37, F.lit(15300)).cast("int"))
    return with_time(docs.select(F.col("doc_id").alias("row_id"), F.col("source").alias("brand"), day.alias("issue_date"), F.coalesce("text", F.lit("")).alias("text")))


def with_time(df: DataFrame, day: str = "issue_date") -> DataFrame:
    return df.withColumns({
        "year": F.year(day),
        "yq": F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")),
        "decade": (F.floor(F.year(day) / 10) * 10).cast("long"),
    })


def in_years(df: DataFrame, day: str, first: int, last: int) -> DataFrame:
    """Rows dated from the first to the last year; compared as dates, so the range can be pushed to the scan."""
    return df.filter((F.col(day) >= F.lit(f"{first}-01-01").cast("timestamp")) & (F.col(day) < F.lit(f"{last + 1}-01-01").cast("timestamp")))


def non_generic(df: DataFrame, flag: str = "is_generic") -> DataFrame:
    """Rows whose flag is false; a null flag does not pass."""
    return df.filter(~F.col(flag))
