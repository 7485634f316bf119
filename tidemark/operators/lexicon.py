"""Lexicon scores of texts: counts for each category, ratios, variants and denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import scoring_tokens

#: A small lexicon for the invented texts: dictionary, category, words. Categories may share words.
LEXICON = [
    ("harvard", "pos", "the with and of thin reed best"), ("harvard", "neg", "that worthless not stupid er la"), ("harvard", "strong", "the that un die"),
    ("lm", "pos", "for of in best den"), ("lm", "neg", "to by worthless scum der"), ("lm", "uncertain", "a on zzz"),
]
STOPWORDS = "the and of to in a is that it for on was be with as by at".split()
#: Outcome columns: name, dictionary, category.
OUTCOMES = [("harvard_pos", "harvard", "pos"), ("harvard_neg", "harvard", "neg"), ("lm_pos", "lm", "pos"), ("lm_neg", "lm", "neg")]


def lexicon(spark: SparkSession, entries=LEXICON) -> DataFrame:
    return spark.createDataFrame([(d, c, w) for d, c, ws in entries for w in sorted(set(ws.split()))], "dictionary string, category string, word string")


def from_wide(wide: DataFrame, word: str, dictionary: str, positive: bool) -> DataFrame:
    """A wide lexicon (one column for each category) as a long one: members are cells not null, or above zero."""
    names = [c for c in wide.columns if c != word]
    cell = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` as double)") > 0, F.lit(False)) if positive else F.col(f"`{c}`").isNotNull()
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), cell(c).alias("member")) for c in names])).alias("r")
    return wide.filter(F.col(word).isNotNull()).select(F.lower(word).alias("word"), rows).filter("r.member").select(F.lit(dictionary).alias("dictionary"), "r.category", "word").distinct()


def counted_tokens(records: DataFrame, variant: str = "all", words: list[str] | None = None) -> Column:
    """Tokens of one variant: all, without stopwords, or those of a word list only."""
    tokens = scoring_tokens(F.col("text"))
    if variant == "no_stopwords":
        return F.filter(tokens, lambda w: ~w.isin(STOPWORDS))
    if variant == "dictionary_only":
        return F.filter(tokens, lambda w: w.isin(words or []))
    return tokens


def score_counts(records: DataFrame, entries=LEXICON) -> DataFrame:
    """row_id, dictionary, category, n: hits with their multiplicity, 0 without any; counted inside the record, so nothing is shuffled."""
    words = {(d, c): sorted(set(ws.split())) for d, c, ws in entries}
    hits = lambda t: F.array(*[F.struct(F.lit(d).alias("dictionary"), F.lit(c).alias("category"), F.size(F.filter(t, lambda w: w.isin(ws))).cast("long").alias("n")) for (d, c), ws in words.items()])  # noqa: B023, E731
    found = F.transform(F.array(counted_tokens(records, "dictionary_only", sorted(set().union(*words.values())))), hits)[0]
    return records.select("row_id", F.explode(found).alias("h")).select("row_id", "h.*")


def scored(records: DataFrame, entries=LEXICON, outcomes=OUTCOMES, variant: str = "all") -> DataFrame:
    """records without text, with total_words and one count column for each outcome, in one pass without a shuffle."""
    words = {(d, c): set(ws.split()) for d, c, ws in entries}
    tokens = counted_tokens(records, variant, sorted(set().union(*words.values())))
    hits = lambda d, c: lambda t: F.size(F.filter(t, lambda w: w.isin(sorted(words[d, c])))).cast("long")
    found = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).cast("long").alias("total_words"), *[hits(d, c)(t).alias(o) for o, d, c in outcomes]))[0]
    return records.withColumn("_s", found).drop("text").select("*", "_s.*").drop("_s")


VARIANTS = ["all", "no_stopwords", "dictionary_only"]


def scored_variants(records: DataFrame, entries=LEXICON, outcomes=OUTCOMES, variants: list[str] = VARIANTS) -> DataFrame:
    """records without text, one row for each variant (column `variant`) with its total_words and counts; texts are read once."""
    words = {(d, c): set(ws.split()) for d, c, ws in entries}
    union = sorted(set().union(*words.values()))
    keep = {"all": lambda t: t, "no_stopwords": lambda t: F.filter(t, lambda w: ~w.isin(STOPWORDS)), "dictionary_only": lambda t: F.filter(t, lambda w: w.isin(union))}
    hits = lambda t, d, c: F.size(F.filter(t, lambda w: w.isin(sorted(words[d, c])))).cast("long")
    one = lambda v: lambda t: F.struct(F.lit(v).alias("variant"), F.size(t).cast("long").alias("total_words"), *[hits(t, d, c).alias(o) for o, d, c in outcomes])
    rows = F.transform(F.array(scoring_tokens(F.col("text"))), lambda t: F.concat(*[F.transform(F.array(keep[v](t)), one(v)) for v in variants]))[0]
    return records.withColumn("_s", rows).drop("text").select(*[c for c in records.columns if c != "text"], F.inline("_s"))


def ratio(count: str, total: str = "total_words") -> Column:
    """Share of words, 0 without words."""
    return F.when(F.col(total) > 0, F.col(count) / F.col(total)).otherwise(F.lit(0.0))
