"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each document gets a few badness measures. Strata are bands of the word count; where
a band has too few labelled good documents to prove anything (LEAST), it is joined with the
next ones. A third of the labelled good documents, picked by a hash of the id, gives each
stratum a path of joint rules from loose to strict, each with a cutoff for every measure.
The others, a holdout, test the rules in that order with an exact binomial test at
DELTA / (number of bands); the last rule before the first failure holds. Testing in a
fixed order needs no correction for the number of rules, one rule for all measures none for
theirs, and the division by the number of bands covers the strata: with probability
1 - DELTA no stratum loses more than ALPHA of its good documents to the learnt rules.

Which bands are joined depends on counts of labels only, never on measures, so the
bound holds for the joined strata. A labelled document is one trial however often it
occurs (with its worst values, in its lowest band), and an id with labels of both kinds
is none. Where even all bands together have fewer than LEAST, there is no rule and the
base rule decides alone.

Null text counts as empty: no words, so the base rule rejects it. Rows with a
null or repeated doc_id keep their own verdicts; repeated labels count once.
Empty tables give empty results. Other columns pass through; the measures are
held in one struct column with a name of its own, so clashing names do no harm.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Staged, fresh, stage_table

ALPHA = 0.02
DELTA = 0.05
#: Upper ends of the word-count bands; the last band is open.
BANDS = (200, 600, 1500)
GRID = tuple(round(0.01 * 1.15**j, 6) for j in range(44))
MEASURES = ("symbols", "capitals", "bangs", "dup_lines", "repeats")
#: The path of joint rules: so many grid steps above the reference's highest values, then shares of it above each cutoff.
SLACK = tuple(range(len(GRID) - 1, -1, -1))
SHARES = (0.0005, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02)


def least_trials(alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Trials without any rejection that prove a rule."""
    return math.ceil(math.log(delta / (len(BANDS) + 1)) / math.log(1 - alpha))


#: Ids whose md5 begins with one of these characters are the reference; the others are the holdout.
REFERENCE = "01234"
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def word_counts(words: Column) -> Column:
    """Struct of n_words, word_chars and n_repeat_words (words inside 3-word windows found twice or more)."""

    def covered(p: Column) -> Column:
        # p: sorted starts of repeated windows, each three words long.
        gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g))

    def from_words(a: Column) -> Column:
        n = F.size(a)
        same = lambda x, y: (x["h"] == y["h"]) & (a[x["i"]] == a[y["i"]]) & (a[x["i"] + 1] == a[y["i"] + 1]) & (a[x["i"] + 2] == a[y["i"] + 2])
        none = F.array().cast("array<int>")
        neighbours = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])).otherwise(none))
        starts = lambda s: F.sort_array(F.array_distinct(F.flatten(neighbours(s))))
        # Hashes put equal windows side by side; the words themselves decide.
        ordered = lambda h: F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        repeats = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered(h), lambda s: _let(starts(s), covered)))
        hashes = F.transform(F.slice(a, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, a[i + 1], a[i + 2]))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(a, "")).cast("long").alias("word_chars"),
            F.when(n < 4, F.lit(0)).otherwise(_let(hashes, repeats)).cast("long").alias("n_repeat_words"),
        )

    return _let(words, from_words)


def line_counts(text: Column) -> Column:
    """Struct of n_lines (lines with a word) and n_dup_lines (those equal to an earlier one)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def measured(docs: DataFrame, into: str = "_quality") -> DataFrame:
    """docs with a struct of counts in the column `into`; exploded from an array of one, so no later filter repeats the counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = F.struct(
        word_counts(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"),
        line_counts(text).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
    )
    return docs.select("*", F.explode(F.array(counts)).alias(into))


def _measures(q: Column) -> dict[str, Column]:
    over = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
    return {
        "symbols": over(q["n_symbols"], q["words"]["word_chars"]),
        "capitals": over(q["n_capitals"], q["words"]["word_chars"]),
        "bangs": over(q["n_bangs"], q["words"]["word_chars"]),
        "dup_lines": over(q["lines"]["n_dup_lines"], q["lines"]["n_lines"]),
        "repeats": over(q["words"]["n_repeat_words"], q["words"]["n_words"]),
    }


def _band(q: Column) -> Column:
    return reduce(lambda a, b: a + b, [(q["words"]["n_words"] >= x).cast("int") for x in BANDS])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed exactly from logarithms of the terms."""
    ratio = p / (1 - p)
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j * ratio)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>")), start, step)["sum"]


def _strata(trials: Column, least: int) -> Column:
    """Stratum of each band: from the lowest on, bands join until they have `least` trials; a rest joins the one before."""
    none = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, n: Column) -> Column:
        full = acc["n"] >= least
        at = acc["at"] + full.cast("int")
        return F.struct(F.concat(acc["of"], F.array(at)).alias("of"), at.alias("at"), (F.when(full, F.lit(0)).otherwise(acc["n"]) + n).alias("n"))

    last = lambda acc: F.when(acc["n"] >= least, acc["at"]).otherwise(F.greatest(acc["at"] - 1, F.lit(0)))
    return F.aggregate(trials, none, step, lambda acc: F.transform(acc["of"], lambda s: F.least(s, last(acc))))


def joint_cutoffs(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, into: str = "_quality") -> DataFrame:
    """From documents with counts: one row for each band with a proven rule: band, cuts (map from measure to cutoff)."""
    q, each, bands = F.col(into), range(len(MEASURES)), len(BANDS) + 1
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = 1 and high = 1").select(F.col("doc_id").alias("_good_id"))
    grid = F.array(*[F.lit(float(g)) for g in GRID])
    below = lambda v: F.size(F.filter(grid, lambda g: g < v))
    steps = [below(v).alias(f"s{m}") for m, v in enumerate(_measures(q).values())]
    known = (
        counted.select("doc_id", _band(q).alias("band"), *steps)
        .join(good, F.col("doc_id") == F.col("_good_id"), "left_semi")
        .groupBy("doc_id")
        .agg(F.min("band").alias("band"), F.array(*[F.max(f"s{m}") for m in each]).alias("steps"))
        .withColumn("reference", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin(*REFERENCE))
    )
    trials = known.agg(F.array(*[F.count_if((F.col("band") == b) & ~F.col("reference")) for b in range(bands)]).alias("n"))
    strata = F.broadcast(trials.select(F.posexplode(_strata(F.col("n"), least_trials(alpha, delta))).alias("band", "stratum")))
    placed = known.join(strata, "band")
    # Reference documents above each grid step, by measure; a rule's cutoff is the first step with so few of them above it.
    steps_of = F.explode(F.transform("steps", lambda s, m: F.struct(m.alias("measure"), s.alias("step")))).alias("x")
    seen = placed.filter("reference").select("stratum", steps_of).groupBy("stratum", "x.measure", "x.step").agg(F.count("*").alias("c"))
    above = lambda j: F.aggregate(F.filter("h", lambda x: x["step"] > j), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    first = lambda share: F.filter(F.sequence(F.lit(0), F.lit(len(GRID))), lambda j: above(j) <= F.lit(share) * F.col("n"))[0]
    tops = seen.groupBy("stratum", "measure").agg(F.sum("c").alias("n"), F.collect_list(F.struct("step", "c")).alias("h"))
    paths = tops.select("stratum", "measure", F.array(*[first(0.0) + s for s in SLACK], *[first(r) for r in SHARES]).alias("path"))
    path = paths.groupBy("stratum").agg(F.array(*[F.max(F.when(F.col("measure") == m, F.col("path"))) for m in each]).alias("by"))
    rules = len(SLACK) + len(SHARES)
    path = path.select("stratum", F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), lambda i: F.transform("by", lambda p: F.get(p, i))).alias("path"))
    breaks = lambda rule: F.exists(F.zip_with("steps", rule, lambda a, b: a > b), lambda x: x)
    # Rules are nested, so a document that breaks some breaks the last ones. Paths are one row a stratum.
    counts = (
        placed.filter("not reference")
        .join(F.broadcast(path), "stratum")
        .select("stratum", F.size(F.filter("path", breaks)).alias("broken"))
        .groupBy("stratum", "broken")
        .agg(F.count("*").alias("c"))
        .groupBy("stratum")
        .agg(F.sum("c").alias("n"), F.collect_list(F.struct("broken", "c")).alias("counts"))
    )
    tested = (
        counts.join(F.broadcast(path), "stratum")
        .select("stratum", "n", "counts", F.posexplode("path").alias("level", "rule"))
        .withColumn("k", F.aggregate(F.filter("counts", lambda x: x["broken"] >= rules - F.col("level")), F.lit(0).cast("long"), lambda a, x: a + x["c"]))
        # Above its mean a binomial tail passes no test, so only smaller counts are summed.
        .withColumn("ok", F.when(F.col("k") >= F.col("n") * alpha, F.lit(False)).otherwise(binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / bands))
    )
    # k rises along the path, so all rules before a proven one are proven too.
    names = F.array(*[F.lit(m) for m in MEASURES])
    cuts = F.map_from_arrays(names, F.transform("rule", lambda j: F.try_element_at(grid, j + 1)))
    proven = tested.filter("ok").groupBy("stratum").agg(F.max_by("rule", "level").alias("rule")).select("stratum", F.map_filter(cuts, lambda _, c: c.isNotNull()).alias("cuts"))
    return strata.join(proven, "stratum").select("band", "cuts")


def verdicts(counted: DataFrame, cuts: DataFrame, into: str = "_quality") -> DataFrame:
    """Replaces the counts in `into` by a flat struct with band, base_failed and kept."""
    q = F.col(into)
    words = q["words"]
    base = (words["n_words"] < 50) | (100 * words["n_repeat_words"] > 50 * words["n_words"])
    # The cutoffs have at most one row for each of the four bands, so they can be broadcast at any size of the corpus.
    band_name, cuts_name = fresh(counted, "_cut_band"), fresh(counted, "_cuts")
    own = F.broadcast(cuts.select(F.col("band").alias(band_name), F.col("cuts").alias(cuts_name)))
    joined = counted.join(own, _band(q) == F.col(band_name), "left")
    broken = reduce(lambda a, b: a | b, [F.coalesce(v > F.try_element_at(F.col(cuts_name), F.lit(k)), F.lit(False)) for k, v in _measures(q).items()])
    kinds = [words["n_words"], words["word_chars"], q["n_symbols"], q["lines"]["n_dup_lines"], q["lines"]["n_lines"], words["n_repeat_words"], q["n_capitals"], q["n_bangs"]]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_capitals", "n_bangs")
    flat = F.struct(*[c.alias(n) for c, n in zip(kinds, names, strict=True)], _band(q).alias("band"), base.alias("base_failed"), (~base & ~broken).alias("kept"))
    return joined.withColumn(into, flat).drop(band_name, cuts_name)


def _learnt(docs: DataFrame, labels: DataFrame, alpha: float, delta: float, passing: Staged) -> tuple[DataFrame, DataFrame]:
    """Counts of all documents without their texts, staged, and the cutoffs (four rows at most), staged."""
    counted = passing.table(measured(docs.select("doc_id", "text")).drop("text"), "quality-counts")
    return counted, stage_table(joint_cutoffs(counted, labels, alpha, delta), "quality-cuts")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, into: str = "_quality") -> DataFrame:
    """docs, all columns, with the verdicts in the struct column `into`; texts are measured twice and never staged."""
    passing = Staged()
    _, cuts = _learnt(docs, labels, alpha, delta, passing)
    passing.drop()
    return verdicts(measured(docs, into), cuts, into)


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id and verdict for each document; the counts are staged, so docs are read once."""
    counted, cuts = _learnt(docs, labels, alpha, delta, Staged())
    return verdicts(counted, cuts).select("doc_id", "_quality.*")
