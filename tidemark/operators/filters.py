"""Record flags and filter versions: blocklists, headers, short texts and groups of text rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import HEADER, LABEL, any_of, has_words, normalized, word_count

# Rule groups, matched in normalised text.
RULES = {
    "tombstone": [
        r"matter of record", r"(?:securities|notes|shares|bonds) (?:have|having) been sold", r"have not been registered under the (?:united states )?securities act",
        r"issued in compliance with the requirements", r"not an invitation to any person to (?:subscribe|purchase)", r"admitted to the official list",
    ],
    "legal_notice": [r"notice is hereby given", r"(?:annual|extraordinary) general meeting", r"judicial publication", r"published by order of"],
    "financial_statement": [
        r"balance sheet as (?:at|of)", r"consolidated balance sheet", r"profit and loss account", r"interim results", r"interim report \d{4}",
        r"highlights of the year", r"three months'? review", r"profit attributable to (?:share|stock)holders",
    ],
    "house": [
        r"economist intelligence unit", r"economist conferences", r"economist\.com/(?:node|debates)", r"intelligent life", r"economist booklets", r"offer to readers",
        r"letters are welcome", r"subscription service", r"economistsubscriptions", r"subscribe to the economist", r"the economist plaza", r"nico colchester",
    ],
    "editorial": [r"also in this section", r"% change on year ago", r"economics focus"],
}
# Phrases that only steer sampling.
CUES = [
    r"\bthe economist\b", r"subscri", r"offer to readers", r"letters are welcome", r"intelligence unit", r"matter of record", r"notice is hereby given",
    r"annual general meeting", r"balance sheet", r"prospectus", r"\bbranches\b", r"interim (?:results|report|dividend)", r"profit (?:before|after) tax",
]
MIN_TOKENS, MIN_HEADERS = 10, 2


def flags(records: DataFrame, blocklist: list[str], header: str = HEADER, label: str = LABEL, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Version 1: blocklisted name (case counts), repeated page headers, too few tokens."""
    out = records.select(
        "row_id", "brand", "decade",
        word_count(F.col("text")).cast("long").alias("token_count"),
        F.regexp_count("text", F.lit(header)).cast("long").alias("header_count"),
        F.regexp_count("text", F.lit(label)).cast("long").alias("label_count"),
    ).withColumns({
        "is_non_advertiser": F.coalesce(F.col("brand").isin(blocklist), F.lit(False)),
        "is_multipage": F.col("header_count") >= MIN_HEADERS,
        "too_short": F.col("token_count") < min_tokens,
    })
    return out.withColumn("any_flag", reduce(lambda a, b: a | b, [F.col(c) for c in ("is_non_advertiser", "is_multipage", "too_short")]))


def rule_hits(records: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """row_id and one boolean for each rule group; the text is normalised once."""
    text = F.col("_text")
    return records.select("row_id", "decade", normalized(F.col("text")).alias("_text")).select("row_id", "decade", *[any_of(text, p).alias(f"rule_{k}") for k, p in rules.items()])


def version_columns(blocklist: list[str], rules: dict[str, list[str]], header: str = HEADER) -> dict[str, Column]:
    """Flags of the versions v1, v2 (names without regard to case), v3 (v2 or any rule) over brand and text."""
    short = ~has_words(F.col("text"), MIN_TOKENS) | (F.regexp_count("text", F.lit(header)) >= MIN_HEADERS)
    named = F.coalesce(F.lower(F.trim("brand")).isin([b.lower().strip() for b in blocklist]), F.lit(False))
    v1 = F.coalesce(F.col("brand").isin(blocklist), F.lit(False)) | short
    v2 = v1 | named
    # A lambda's variable is worked out once wherever the flag stands; a filter would write the normal form out for each part.
    found = F.transform(F.array(normalized(F.col("text"))), lambda text: any_of(text, [p for ps in rules.values() for p in ps]))[0]
    return {"v1": v1, "v2": v2, "v3": v2 | found}


def versions(records: DataFrame, blocklist: list[str], rules: dict[str, list[str]], header: str = HEADER) -> DataFrame:
    """row_id, decade, brand and the flags of the versions: each holds the one before."""
    return records.select("row_id", "decade", "brand", *[c.alias(v) for v, c in version_columns(blocklist, rules, header).items()])


def strata(records: DataFrame, cues: list[str], quantile: float = 0.85) -> DataFrame:
    """row_id, decade, stratum: cue, else long (words at or above the decade's quantile), else other."""
    counted = records.select("row_id", "decade", word_count(F.col("text")).cast("long").alias("words"), any_of(F.col("text"), cues, "(?i)").alias("cue"))
    cut = counted.groupBy("decade").agg(F.percentile("words", F.lit(quantile)).alias("cut"))
    stratum: Column = F.when(F.col("cue"), "cue").when(F.col("words") >= F.col("cut"), "long").otherwise("other")
    return counted.join(cut, "decade").select("row_id", "decade", "words", stratum.alias("stratum"))


def rederived(records: DataFrame, blocklist: list[str]) -> DataFrame:
    """row_id, listed, named: whether the brand is on the list as written, and whether it is one of the brands so found, in any case.

    The brands found are at most as many as the list has entries, so they are broadcast.
    """
    brand = F.trim(F.coalesce("brand", F.lit("")))
    rows = records.select("row_id", brand.isin(blocklist).alias("listed"), F.lower(brand).alias("_brand"))
    found = rows.filter("listed").select("_brand").distinct().withColumn("_found", F.lit(True))
    return rows.join(F.broadcast(found), "_brand", "left").select("row_id", "listed", F.coalesce("_found", F.lit(False)).alias("named"))
