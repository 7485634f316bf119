"""The registered queries: each applies operators to the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import dist
from tidemark.functions import text as X
from tidemark.operators import cycle, filters, lexicon, linear, sampling, series, stats, structural, topics, validation, words
from tidemark.sources import tables
from tidemark.sources.store import ResultStore
from tidemark.sources.tables import records, table
from tidemark.streaming.incremental import daily

OUT = [o for o, _, _ in lexicon.OUTCOMES]
#: Lists for the invented records, beside the fixed rule groups.
BLOCKLIST = ["src3", "SRC5"]
HEADER = r"[A-Z][a-z]+\. [A-Z][a-z]+ "
RULES = filters.RULES | {"licence": [r"all rights reserved", r"licen[sc]ed under"]}
CUES = [*filters.CUES, r"\brights reserved\b", r"password"]
SECTORS = [("North", ["src1*", "src2"]), ("South", ["src3", "src4", "src5"]), ("West", ["src6", "src7", "src1"])]
# Rows to draw by decade and stratum.
QUOTAS = {1940: {"cue": 3, "long": 2, "other": 5}} | {d: {"cue": 5, "long": 5, "other": 10} for d in range(1950, 2020, 10)}
#: Regression settings: name, controls, fixed effects.
SPECS = [("raw", (), ()), ("trend", ("t",), ()), ("decade", (), ("decade",))]
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def scores(spark, sf_dir, variant="all"):
    return lexicon.scored(records(spark, sf_dir), variant=variant)


def panel(spark: SparkSession, sf_dir: str, kind: str = "macro") -> DataFrame:
    """yq, outcome, y, x (recession majority), decade, post, t."""
    make = {"macro": series.macro, "pooled": series.pooled}[kind]
    long = series.long_panel(make(scores(spark, sf_dir), OUT), OUT)
    cal = cycle.calendar(spark).select("yq", F.col("recession_majority").cast("int").alias("x"), F.col("recession_any").cast("int").alias("x_any"))
    both = long.join(F.broadcast(cal), "yq")
    year = F.substring("yq", 1, 4).cast("int")
    return both.withColumns({"decade": (F.floor(year / 10) * 10).cast("int"), "post": (year >= 1973).cast("int"), "t": (F.row_number().over(W.partitionBy("outcome").orderBy("yq")) - 1).cast("long")})


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly revenue, in whole cents before it is summed."""
    day = F.col("l_shipdate").cast("date")
    yq = F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(yq.alias("yq")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("value"))


@query
def score_counts(spark, sf_dir):
    return lexicon.score_counts(records(spark, sf_dir))


@query
def score_ratios_wide(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("row_id", "total_words", *[lexicon.ratio(o).alias(o) for o in OUT]), *OUT)


@query
def variant_no_stopwords(spark, sf_dir):
    return scores(spark, sf_dir, "no_stopwords").select("row_id", "total_words", *OUT)


@query
def variant_dictionary_only(spark, sf_dir):
    return scores(spark, sf_dir, "dictionary_only").select("row_id", "total_words", *OUT)


@query
def denominator_comparison(spark, sf_dir):
    rows = lexicon.scored_variants(records(spark, sf_dir))
    out = rows.groupBy("variant").agg(F.avg("total_words").alias("mean_words"), F.median("total_words").alias("median_words"), F.count_if(F.col("total_words") == 0).alias("no_words"), F.avg(lexicon.ratio("harvard_pos")).alias("mean_ratio"))
    return rounded(out, "mean_words", "mean_ratio")


@query
def quarterly_macro(spark, sf_dir):
    return rounded(series.macro(scores(spark, sf_dir), OUT), *OUT)


@query
def quarterly_pooled(spark, sf_dir):
    return rounded(series.pooled(scores(spark, sf_dir), OUT), *OUT)


@query
def cycle_calendar(spark, sf_dir):
    """The calendar with the records of each quarter."""
    n = records(spark, sf_dir).groupBy("yq").agg(F.count("*").alias("records"))
    return cycle.calendar(spark).join(F.broadcast(n), "yq", "left").fillna(0, ["records"])


@query
def technical_recession(spark, sf_dir):
    return rounded(cycle.growth(revenue(spark, sf_dir)), "growth")


@query
def rule_agreement(spark, sf_dir):
    return cycle.agreement(cycle.calendar(spark), cycle.growth(revenue(spark, sf_dir)))


@query
def recession_gap_grid(spark, sf_dir):
    """Both aggregations of each quarter from one scan, then the gap under both definitions."""
    s = scores(spark, sf_dir).filter("total_words > 0")
    macro, pooled = (F.array(*[F.struct(F.lit(o).alias("outcome"), y(o).alias("y")) for o in OUT]) for y in (lambda o: 100 * F.avg(F.col(o) / F.col("total_words")), lambda o: 100 * F.sum(o) / F.sum("total_words")))
    q = s.groupBy("yq").agg(macro.alias("macro"), pooled.alias("pooled"))
    long = q.select("yq", F.explode(F.create_map(F.lit("macro"), "macro", F.lit("pooled"), "pooled")).alias("aggregation", "rows")).select("yq", "aggregation", F.inline("rows"))
    state = F.explode(F.create_map(F.lit("majority"), F.col("recession_majority"), F.lit("any"), F.col("recession_any"))).alias("definition", "state")
    p = long.join(F.broadcast(cycle.calendar(spark).select("yq", state)), "yq")
    return rounded(series.gaps(p, ["aggregation", "definition", "outcome"], F.col("state")).select("aggregation", "definition", "outcome", "gap"), "gap")


@query
def normalized_effect(spark, sf_dir):
    return rounded(series.gaps(panel(spark, sf_dir), ["outcome"], F.col("x") == 1), "mean_recession", "mean_expansion", "mean_y", "gap", "pct_of_level", "pct_of_mean")


@query
def aggregation_comparison(spark, sf_dir):
    both = panel(spark, sf_dir).withColumn("kind", F.lit("macro")).unionByName(panel(spark, sf_dir, "pooled").withColumn("kind", F.lit("pooled")))
    gap = series.gaps(both, ["outcome", "kind"], F.col("x") == 1).groupBy("outcome").agg(*[F.max(F.when(F.col("kind") == k, F.col("gap"))).alias(f"gap_{k}") for k in ("macro", "pooled")])
    pair = both.groupBy("outcome", "yq").agg(*[F.max(F.when(F.col("kind") == k, F.col("y"))).alias(k) for k in ("macro", "pooled")])
    r = pair.groupBy("outcome").agg(F.corr("macro", "pooled").alias("correlation"))
    return rounded(gap.join(r, "outcome").withColumn("same_sign", F.col("gap_macro") * F.col("gap_pooled") >= 0), "gap_macro", "gap_pooled", "correlation")


@query
def sensitivity_range(spark, sf_dir):
    rows = lexicon.scored_variants(records(spark, sf_dir)).filter("total_words > 0")
    q = rows.groupBy("variant", "yq").agg(*[(100 * F.avg(F.col(o) / F.col("total_words"))).alias(o) for o in OUT])
    long = q.select("variant", "yq", F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y")) for o in OUT])))
    parts = series.gaps(with_state(spark, long), ["outcome", "variant"], F.col("state"))
    out = parts.groupBy("outcome").agg((F.max("pct_of_level") - F.min("pct_of_level")).alias("range_pct"), F.bool_and(F.col("gap") > 0).alias("all_up"), F.bool_and(F.col("gap") < 0).alias("all_down"))
    return rounded(out, "range_pct")


@query
def measure_discovery(spark, sf_dir):
    """Which of twelve measures gives a stored quarterly series again (that of stopword-free negative words), in one scan."""
    rows = lexicon.scored_variants(records(spark, sf_dir)).filter("total_words > 0")
    wide = rows.groupBy("yq").pivot("variant", lexicon.VARIANTS).agg(*[(100 * F.avg(F.col(o) / F.col("total_words"))).alias(f"{o}_ratio") for o in OUT])
    stored = ResultStore(spark).get("stored_series", [f"{sf_dir}/documents.parquet"], {"measure": "harvard_neg"}, lambda: series.macro(scores(spark, sf_dir, "no_stopwords"), ["harvard_neg"]).select("yq", F.col("harvard_neg").alias("value")))
    return rounded(series.reproduced(wide, series.columns_by_suffix(wide, "_ratio"), stored), "max_error")


@query
def quality_flags_v1(spark, sf_dir):
    return filters.flags(records(spark, sf_dir), BLOCKLIST, HEADER)


@query
def filter_v2(spark, sf_dir):
    return filters.versions(records(spark, sf_dir), BLOCKLIST, RULES, HEADER).select("row_id", "v1", "v2")


@query
def filter_v3_rules(spark, sf_dir):
    return filters.rule_hits(records(spark, sf_dir), RULES).drop("decade")


@query
def rule_hits_by_decade(spark, sf_dir):
    hits = filters.rule_hits(records(spark, sf_dir), RULES)
    return hits.groupBy("decade").agg(F.count("*").alias("n"), *[F.count_if(f"rule_{r}").alias(f"n_{r}") for r in RULES])


@query
def flag_rate_by_decade(spark, sf_dir):
    v = filters.versions(records(spark, sf_dir), BLOCKLIST, RULES, HEADER)
    return rounded(v.groupBy("decade").agg(*[(100 * F.avg(F.col(c).cast("double"))).alias(f"pct_{c}") for c in ("v1", "v2", "v3")]), "pct_v1", "pct_v2", "pct_v3")


@query
def blocklist_candidates(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("words", X.word_count(F.col("text")))
    out = rows.groupBy("brand").agg(F.count_if(F.col("words") > 1000).alias("long_records"), F.count("*").alias("records"))
    return out.filter("long_records > 0").orderBy(F.desc("long_records"), "brand").limit(40)


@query
def filter_before_after(spark, sf_dir):
    """Gaps with all records and with those that v3 keeps, from one scan; rows that share an id are paired, as a join on it does."""
    flag = filters.version_columns(BLOCKLIST, RULES, HEADER)["v3"]
    own = W.partitionBy("row_id")
    s = lexicon.scored(records(spark, sf_dir).filter("row_id is not null").withColumn("v3", flag)).select("row_id", "yq", "v3", "total_words", *OUT)
    s = s.withColumns({"gap_before": F.count("*").over(own), "gap_after": F.count_if(~F.col("v3")).over(own)}).filter("total_words > 0")
    mean = lambda o, n: (100 * F.sum(F.col(n) * F.col(o) / F.col("total_words")) / F.nullif(F.sum(n), F.lit(0))).alias("y")
    cells = F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(n).alias("rows"), mean(o, n)) for o in OUT for n in ("gap_before", "gap_after")])
    panel_ = s.groupBy("yq").agg(cells.alias("cells")).select("yq", F.inline("cells")).filter("y is not null")
    found = series.gaps(with_state(spark, panel_), ["outcome", "rows"], F.col("state"))
    out = found.groupBy("outcome").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("rows") == n, F.col("gap"))).alias(n) for n in ("gap_before", "gap_after")]).filter("n = 2").drop("n")
    return rounded(out.withColumns({"change": F.col("gap_after") - F.col("gap_before"), "same_direction": F.col("gap_after") * F.col("gap_before") >= 0}), "gap_before", "gap_after", "change")


def labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("quality") == 0).alias("non_ad"))
    return filters.versions(records(spark, sf_dir), BLOCKLIST, RULES, HEADER).join(labels, "row_id")


@query
def confusion_metrics(spark, sf_dir):
    """All versions against the labels, in one pass over the texts."""
    rows = labelled(spark, sf_dir).select("non_ad", F.inline(F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).alias("flag")) for v in ("v1", "v2", "v3")])))
    cells = validation.confusion_by(rows, ["version"], "flag", "non_ad")
    return rounded(validation.rates(cells), "precision", "recall", "specificity", "agreement", "residual")


@query
def checked_labels(spark, sf_dir):
    """Labels beside the filter's verdict, with checks that ride on the pass that writes them: unique keys, no null label, full agreement of the row counts."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("quality") == 0).alias("non_ad"))
    joined, keys = validation.unique_join(filters.versions(records(spark, sf_dir), BLOCKLIST, RULES, HEADER).select("row_id", "decade", "v3"), labels, "row_id", "inner")
    values = validation.Carried([("null flags", F.count_if(F.col("v3").isNull()), lambda n: n == 0, True), ("rows", F.count("*"), lambda n: n > 0, True), ("both classes", F.count_if("non_ad"), lambda n: n > 0, False)])
    inputs = [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"]
    out = ResultStore(spark).get("checked_labels", inputs, {"code": 1}, lambda: values.watch(joined), lambda: [*keys.verdicts(), *values.verdicts()])
    return out.groupBy("decade").agg(F.count("*").alias("labelled"), F.count_if("non_ad").alias("non_ads"), F.count_if(F.col("v3") == F.col("non_ad")).alias("agree"))


@query
def wilson_kappa(spark, sf_dir):
    low, high = validation.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    out = validation.confusion(labelled(spark, sf_dir), "v3", "non_ad").select(low.alias("low"), high.alias("high"), validation.kappa().alias("kappa"))
    return rounded(out, "low", "high", "kappa")


@query
def missed_by_reason(spark, sf_dir):
    missed = labelled(spark, sf_dir).filter("non_ad and not v3")
    return missed.groupBy("decade").agg(F.count("*").alias("missed"), F.array_join(F.sort_array(F.collect_set("brand")), ",").alias("brands"))


@query
def stratified_sample(spark, sf_dir):
    rows = filters.strata(records(spark, sf_dir), CUES)
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    return rounded(sampling.stratified(rows, QUOTAS, 314, known), "weight")


@query
def simple_sample(spark, sf_dir):
    return sampling.simple_sample(records(spark, sf_dir).select("row_id", "brand"), 100, 314)


@query
def weighted_recall(spark, sf_dir):
    drawn = sampling.stratified(filters.strata(records(spark, sf_dir), CUES), QUOTAS, 314)
    out = validation.weighted_rates(labelled(spark, sf_dir).join(drawn.select("row_id", "weight"), "row_id"), "v3", "non_ad", "weight")
    return rounded(out, "recall", "precision", "prevalence")


@query
def audit_sample(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    return sampling.audit(filters.rule_hits(records(spark, sf_dir), RULES), list(RULES), 30, 314, known)


@query
def word_count_profile(spark, sf_dir):
    n = X.word_count(F.col("text"))
    rows = records(spark, sf_dir).select(n.alias("n"))
    ladder = [F.count_if(F.col("n") < k).alias(f"under_{k}") for k in (1, 5, 10, 15, 20, 30)]
    return rounded(rows.agg(F.count("*").alias("count"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").cast("long").alias("min"), F.max("n").cast("long").alias("max"), *ladder), "mean", "std")


@query
def word_count_quantiles(spark, sf_dir):
    n = X.word_count(F.col("text"))
    out = records(spark, sf_dir).select("decade", n.alias("n")).groupBy("decade").agg(*[F.percentile("n", F.lit(q / 100)).alias(f"q{q}") for q in (25, 50, 75, 85)])
    return rounded(out, "q25", "q50", "q75", "q85")


@query
def brand_key(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("brand")).unionByName(table(spark, sf_dir, "part").select(F.concat_ws(" ", F.col("p_brand"), F.lit("& Co."), F.col("p_type")).alias("brand"))).distinct()
    return names.select("brand", X.brand_key(F.col("brand")).alias("brand_key"))


def sectored(spark, sf_dir):
    r = records(spark, sf_dir)
    names = r.select("brand").distinct().withColumn("brand_key", F.coalesce(X.brand_key(F.col("brand")), F.lit("(missing brand)")))
    names = names.withColumn("sector", X.first_rule(F.col("brand_key"), SECTORS))
    return r.drop("text").join(names, r["brand"].eqNullSafe(names["brand"])).drop(names["brand"])


@query
def sector_assign(spark, sf_dir):
    return sectored(spark, sf_dir).select("brand", "brand_key", "sector").distinct()


@query
def sector_share_crosstab(spark, sf_dir):
    rows = sectored(spark, sf_dir)
    names = [s for s, _ in SECTORS] + ["Other"]
    wide = rows.groupBy("yq").pivot("sector", names).count().fillna(0, names)
    total = sum(F.col(n) for n in names)
    return rounded(wide.select("yq", *[(F.col(n) / total).alias(n.lower()) for n in names]), *[n.lower() for n in names])


@query
def composition_series(spark, sf_dir):
    rows = sectored(spark, sf_dir)
    long_running = rows.groupBy("brand_key").agg((F.countDistinct("year") >= 10).alias("long_running"))
    out = rows.join(long_running, "brand_key").groupBy("yq").agg(F.count("*").alias("ads"), F.countDistinct("brand_key").alias("advertisers"), F.avg(F.col("long_running").cast("double")).alias("long_running_share"))
    return rounded(out.withColumn("ads_per_advertiser", F.col("ads") / F.col("advertisers")), "long_running_share", "ads_per_advertiser")


@query
def long_running_share(spark, sf_dir):
    return sectored(spark, sf_dir).groupBy("brand_key").agg(F.count("*").alias("ads"), F.countDistinct("year").alias("years")).withColumn("long_running", F.col("years") >= 10)


def with_state(spark, rows):
    return rows.join(F.broadcast(cycle.calendar(spark).select("yq", F.col("recession_majority").alias("state"))), "yq")


@query
def switchers(spark, sf_dir):
    rows = with_state(spark, sectored(spark, sf_dir))
    return rows.groupBy("brand_key").agg(F.count("*").alias("ads"), F.min("state").alias("lo"), F.max("state").alias("hi")).filter("ads >= 2 and lo <> hi").select("brand_key", "ads")


@query
def shift_share(spark, sf_dir):
    y = scores(spark, sf_dir).filter("total_words > 0").select("row_id", (100 * F.col("harvard_pos") / F.col("total_words")).alias("y"))
    rows = with_state(spark, sectored(spark, sf_dir)).join(y, "row_id")
    return rounded(series.shift_share(rows), "between", "within", "total")


@query
def ols_baseline(spark, sf_dir):
    """Recession alone: slope with classical error, p and interval of t(n - 2)."""
    out = linear.regress(panel(spark, sf_dir), ["outcome"], ["x"])
    return rounded(out.select("outcome", "coef", "intercept", "r2", "se_ols", F.col("p_ols").alias("p"), "low", "high", "n"), "coef", "intercept", "r2", "se_ols", "p", "low", "high")


@query
def hc3(spark, sf_dir):
    return rounded(linear.regress(panel(spark, sf_dir), ["outcome"], ["x"]).select("outcome", "coef", "se_hc3", F.col("p_hc3").alias("p")), "coef", "se_hc3", "p")


@query
def breusch_pagan(spark, sf_dir):
    """Both forms of the test with their p-values, of chi-squared and F."""
    names = ["bp_lm", "bp_lm_p", "bp_f", "bp_f_p"]
    return rounded(linear.regress(panel(spark, sf_dir), ["outcome"], ["x"]).select("outcome", *names), *names)


def _hac(spark, sf_dir, spec, x="x", kind="macro"):
    _, controls, within = next(s for s in SPECS if s[0] == spec)
    return stats.hac(panel(spark, sf_dir, kind), ["outcome"], "yq", list(controls), list(within), x=x)


@query
def hac_raw(spark, sf_dir):
    return rounded(_hac(spark, sf_dir, "raw").select("outcome", "coef", "se", "n"), "coef", "se")


@query
def hac_trend(spark, sf_dir):
    return rounded(_hac(spark, sf_dir, "trend").select("outcome", "coef", "se", "n"), "coef", "se")


@query
def hac_decade(spark, sf_dir):
    return rounded(_hac(spark, sf_dir, "decade").select("outcome", "coef", "se", "n"), "coef", "se")


@query
def hac_small_sample(spark, sf_dir):
    """The small-sample form: error times n / (n - k), p of t(n - k), interval of 1.96 errors."""
    out = stats.hac(panel(spark, sf_dir), ["outcome"], "yq", adjust=2).select("outcome", "coef", "se", "n")
    out = out.withColumns({"p": dist.t_p_column("coef / se", "n - 2"), "low": F.col("coef") - 1.96 * F.col("se"), "high": F.col("coef") + 1.96 * F.col("se")})
    return rounded(out.drop("n"), "coef", "se", "p", "low", "high")


@query
def durbin_watson(spark, sf_dir):
    out = _hac(spark, sf_dir, "raw").select("outcome", F.col("dw").alias("dw_raw")).join(_hac(spark, sf_dir, "decade").select("outcome", F.col("dw").alias("dw_decade")), "outcome")
    return rounded(out, "dw_raw", "dw_decade")


@query
def hac_interaction_1973(spark, sf_dir):
    """Effect after 1973: the coefficient of recession x post beside recession x pre, post and the trend."""
    p = panel(spark, sf_dir).withColumns({"x_post": F.col("x") * F.col("post"), "x_pre": F.col("x") * (1 - F.col("post"))})
    return rounded(stats.hac(p, ["outcome"], "yq", ["t", "post", "x_pre"], x="x_post").select("outcome", "coef", "se"), "coef", "se")


#: The sales table's years are moved by so many, so that they overlap a recession.
SALES_SHIFT = 8
#: Model, sample, regressors. The restricted sample has the annual series; the trend counts all quarters.
MACRO_SPECS = [
    ("recession", "full", ["x"]), ("recession", "restricted", ["x"]), ("recession+inflation+trend", "restricted", ["x", "inflation", "t"]),
    ("growth", "restricted", ["growth"]), ("growth+inflation+trend", "restricted", ["growth", "inflation", "t"]),
    ("recession+growth", "full", ["x", "growth"]), ("growth", "full", ["growth"]),
]
MACRO_VALUES = ["coef", "se_hac", "p_hac", "se_hc3", "r2", "f", "f_p", "bp_lm", "bp_lm_p"]


def macro_panel(spark, sf_dir):
    """The panel beside growth of quarterly sales and the yearly change of the mean price, which fills its quarters."""
    year = F.year("l_shipdate") + SALES_SHIFT
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sales = table(spark, sf_dir, "lineitem").groupBy(year.alias("year"), F.quarter("l_shipdate").alias("quarter")).agg(F.sum(cents).alias("value"), F.sum("l_quantity").cast("long").alias("pieces"))
    quarters = sales.select(F.concat(F.col("year").cast("string"), F.lit("Q"), F.col("quarter").cast("string")).alias("yq"), "value")
    yearly = sales.groupBy("year").agg((F.sum("value") / F.sum("pieces")).alias("price"))
    before = yearly.select((F.col("year") + 1).alias("year"), F.col("price").alias("price_before"))
    inflation = yearly.join(before, "year").select("year", (100 * (F.col("price") / F.col("price_before") - 1)).alias("inflation"))
    p = panel(spark, sf_dir).withColumn("year", F.substring("yq", 1, 4).cast("int"))
    return p.join(F.broadcast(cycle.growth(quarters).select("yq", "growth")), "yq", "left").join(F.broadcast(inflation), "year", "left")


@query
def macro_controls(spark, sf_dir):
    """Recession, growth, inflation and trend in seven models, on all quarters and on those with an annual series."""
    make = lambda: macro_panel(spark, sf_dir)
    p = ResultStore(spark).get("macro_panel", [f"{sf_dir}/documents.parquet", f"{sf_dir}/lineitem.parquet"], {"shift": SALES_SHIFT, "code": 1}, make)
    parts = []
    for k in (1, 2, 3):  # models of one size are cells of one regression
        specs = [s for s in MACRO_SPECS if len(s[2]) == k]
        cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("sample"), F.array(*[F.col(x).cast("double") for x in xs]).alias("xs"), F.array(*map(F.lit, xs)).alias("names")) for m, s, xs in specs])
        rows = p.select("outcome", "yq", "y", "inflation", F.inline(cells)).filter("sample = 'full' or inflation is not null")
        rows = rows.select("outcome", "model", "sample", "names", "yq", "y", *[F.get("xs", F.lit(i)).alias(f"x{i}") for i in range(k)])
        found = linear.regress(rows, ["outcome", "model", "sample", "names"], [f"x{i}" for i in range(k)], order="yq")
        parts.append(found.withColumn("term", F.get("names", F.substring("term", 2, 2).cast("int"))))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("p_hac", dist.normal_p_column(F.col("coef"), F.col("se_hac")))
    return rounded(out.select("outcome", "model", "sample", "term", *MACRO_VALUES, "n"), *MACRO_VALUES)


def effect_sums(spark, sf_dir):
    """Records by advertiser, year and state: all, those with words, and the sum of their ratios; one scan, one grouping."""
    y = F.when(F.col("total_words") > 0, 100 * F.col("harvard_pos") / F.col("total_words"))
    key = F.coalesce(X.brand_key(F.col("brand")), F.lit("(missing brand)"))
    rows = with_state(spark, scores(spark, sf_dir).select(key.alias("brand_key"), "year", "decade", "yq", y.alias("y")))
    return rows.groupBy("brand_key", "year", "decade", F.col("state").cast("int").alias("x")).agg(F.count("*").alias("ads"), F.count("y").alias("n"), F.sum("y").alias("y"))


def one_effect(sums, effect="brand_key", **how):
    r = stats.absorbed_sums(sums.filter("n > 0").withColumn("cell", F.lit("all")), "cell", effect, "year", ["y"], **how)
    rows = [(round(x["coef"], 9), round(x["se"], 9), x["n"], x["clusters"]) for x in r]
    return sums.sparkSession.createDataFrame(rows, "coef double, se double, n bigint, clusters bigint")


@query
def fe_advertiser_cluster(spark, sf_dir):
    return one_effect(effect_sums(spark, sf_dir))


@query
def fe_two_way_cluster(spark, sf_dir):
    """Advertisers absorbed, decades as dummies (those of the calendar; without records they drop out)."""
    return one_effect(effect_sums(spark, sf_dir), dummies="decade", levels=tuple(range(1950, 2020, 10)))


@query
def fe_decade_sector(spark, sf_dir):
    """Sectors absorbed, decades as dummies."""
    sums = effect_sums(spark, sf_dir).withColumn("sector", X.first_rule(F.col("brand_key"), SECTORS))
    return one_effect(sums, "sector", dummies="decade", levels=tuple(range(1950, 2020, 10)))


@query
def holm(spark, sf_dir):
    """The step-down correction over all suppliers: does a supplier's mean price differ from the mean of all?"""
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum(price).alias("total"), F.stddev_samp(price.cast("double")).alias("sd"))
    grand = own.agg((F.sum("total") / F.sum("n")).alias("grand"))
    z = own.join(F.broadcast(grand)).filter("n > 1 and sd > 0").select("s_suppkey", ((F.col("total") / F.col("n") - F.col("grand")) / (F.col("sd") / F.sqrt("n"))).alias("z"))
    p = z.select("s_suppkey", F.round(dist.normal_p_column(F.col("z"), F.lit(1.0)), 9).alias("p"))
    return rounded(stats.holm(p, ties=("s_suppkey",)), "p", "p_holm")


@query
def fe_switchers(spark, sf_dir):
    """Advertiser fixed effects on advertisers with two or more records and both states only."""
    sums = effect_sums(spark, sf_dir)
    both = sums.groupBy("brand_key").agg(F.sum("ads").alias("ads"), F.min("x").alias("lo"), F.max("x").alias("hi")).filter("ads >= 2 and lo < hi")
    return one_effect(sums.join(both.select("brand_key"), "brand_key", "left_semi"))


@query
def year_range(spark, sf_dir):
    """Orders of a range of years by quarter; the range reaches the scan as a comparison of dates."""
    kept = tables.in_years(table(spark, sf_dir, "orders"), "o_orderdate", 1996, 1999)
    yq = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return kept.groupBy(yq.alias("yq")).agg(F.count("*").alias("orders"))


@query
def letter_words(spark, sf_dir):
    """Words of letters of any script, by decade."""
    rows = records(spark, sf_dir).select("decade", F.size(X.letter_tokens(F.col("text"))).cast("long").alias("n"))
    return rows.groupBy("decade").agg(F.sum("n").alias("words"), F.max("n").alias("longest"))


@query
def segmented_words(spark, sf_dir):
    """Words by the boundary rules, by decade: how many, how many with a mark inside, how many of letters and digits."""
    rows = records(spark, sf_dir).select("decade", X.boundary_tokens(F.col("text")).alias("w"))
    count = lambda test: F.sum(F.size(F.filter("w", test))).cast("long")
    return rows.groupBy("decade").agg(F.sum(F.size("w")).cast("long").alias("words"), count(lambda w: w.rlike(r"['.:\u2019]")).alias("marked"), count(lambda w: w.rlike("[0-9]")).alias("with_digits"))


VERSIONS = ["none", "v1", "v2", "v3"]
AD_SPECS = [("decade", "decade", None), ("decade+advertiser", "brand_key", "decade")]
GRID_KEY = ["version", "level", "aggregation", "definition", "outcome", "spec"]
ESTIMATES = ["coef", "se", "p", "mean_y", "pct_of_mean", "ci_low_pct", "ci_high_pct"]


def cell_sums(spark, sf_dir):
    """The sums that the grid is made of, from the store while the documents are as they were."""
    return ResultStore(spark).get("cell_sums", [f"{sf_dir}/documents.parquet"], {"versions": VERSIONS, "outcomes": OUT}, lambda: grouped_cells(spark, sf_dir))


def grouped_cells(spark, sf_dir):
    """version, brand_key, yq: n, words, and for each outcome the sum of counts (c_) and of ratios in percent (y_).

    All of the grid is computed from this table: the texts are read once and grouped once, for every filter version.
    """
    flags = filters.version_columns(BLOCKLIST, RULES, HEADER)
    rows = lexicon.scored(records(spark, sf_dir).withColumns(flags))
    # Outer, and filtered behind: a filter ahead of it would tokenise and match every text once more.
    kept = F.when(F.col("total_words") > 0, F.array_compact(F.array(F.lit("none"), *[F.when(~F.col(v), F.lit(v)) for v in flags])))
    rows = rows.select(F.explode_outer(kept).alias("version"), F.coalesce(X.brand_key(F.col("brand")), F.lit("(missing brand)")).alias("brand_key"), "yq", "total_words", *OUT).filter("version is not null")
    sums = [f for o in OUT for f in (F.sum(o).alias(f"c_{o}"), F.sum(100 * F.col(o) / F.col("total_words")).alias(f"y_{o}"))]
    return rows.groupBy("version", "brand_key", "yq").agg(F.count("*").alias("n"), F.sum("total_words").alias("words"), *sums)


def quarterly_grid(spark, sums):
    """version x aggregation x definition x spec x outcome, with the normal p-value."""
    n, words = F.sum("n"), F.sum("words")
    q = sums.groupBy("version", "yq").agg(*[F.array(*[F.struct(F.lit(o).alias("outcome"), y.alias("y")) for o in OUT for y in [value(o)]]).alias(k) for k, value in (("macro", lambda o: F.sum(f"y_{o}") / n), ("pooled", lambda o: 100 * F.sum(f"c_{o}") / words))])
    long = q.select("version", "yq", F.explode(F.create_map(F.lit("macro"), "macro", F.lit("pooled"), "pooled")).alias("aggregation", "rows")).select("version", "yq", "aggregation", F.inline("rows"))
    state = F.explode(F.create_map(F.lit("majority"), F.col("recession_majority"), F.lit("any"), F.col("recession_any"))).alias("definition", "state")
    cal = cycle.calendar(spark).select("yq", state).withColumn("x", F.col("state").cast("int")).drop("state")
    year = F.substring("yq", 1, 4).cast("int")
    p = long.join(F.broadcast(cal), "yq").withColumns({"decade": (F.floor(year / 10) * 10).cast("int"), "t": 4 * year + F.substring("yq", 6, 1).cast("int")})
    cell = ["version", "aggregation", "definition", "outcome"]
    parts = [stats.hac(p, cell, "yq", list(controls), list(within)).withColumn("spec", F.lit(spec)) for spec, controls, within in SPECS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(*cell, F.lit("quarterly").alias("level"), "spec", "coef", "se", dist.normal_p_column(F.col("coef"), F.col("se")).alias("p"), "mean_y", "n")


def record_grid(spark, sums):
    """version x spec x outcome on records of advertisers with two or more, clustered by year, with p of t(clusters - 1)."""
    cal = F.broadcast(cycle.calendar(spark).select("yq", F.col("recession_majority").cast("int").alias("x")))
    year = F.substring("yq", 1, 4).cast("int")
    rows = sums.withColumns({"year": year, "decade": (F.floor(year / 10) * 10).cast("int"), "ads": F.sum("n").over(W.partitionBy("version", "brand_key"))}).filter("ads >= 2").join(cal, "yq")
    found = []
    for spec, effect, dummies in AD_SPECS:
        # The decades of the calendar, a short fixed list; those without records drop out of the solution.
        levels = tuple(range(1950, 2020, 10)) if dummies else ()
        for r in stats.absorbed_sums(rows, "version", effect, "year", [f"y_{o}" for o in OUT], dummies=dummies, levels=levels):
            p = dist.t_p(r["coef"] / r["se"], r["clusters"] - 1) if r["se"] > 0 else None
            found.append((r["cell"], "per ad", "majority", r["outcome"][2:], "ad", spec, r["coef"], r["se"], p, r["mean_y"], r["n"]))
    return spark.createDataFrame(found, "version string, aggregation string, definition string, outcome string, level string, spec string, coef double, se double, p double, mean_y double, n bigint")


def grid(spark, sf_dir):
    """All 224 estimates: four filter versions of 48 quarterly cells and 8 on records."""
    sums = cell_sums(spark, sf_dir)
    out = quarterly_grid(spark, sums).unionByName(record_grid(spark, sums)).withColumn("pct_of_mean", 100 * F.col("coef") / F.col("mean_y"))
    side = 196 * F.col("se") / F.col("mean_y")
    return out.withColumns({"ci_low_pct": F.col("pct_of_mean") - side, "ci_high_pct": F.col("pct_of_mean") + side}).select(*GRID_KEY, *ESTIMATES, "n")


@query
def model_grid(spark, sf_dir):
    return rounded(grid(spark, sf_dir), *ESTIMATES)


@query
def ladder(spark, sf_dir):
    """Five steps without a filter and under v3, with the shift between the two, for each outcome."""
    steps = grid(spark, sf_dir).filter("version in ('none', 'v3') and (level = 'ad' or aggregation = 'macro' and definition = 'majority')")
    both = steps.withColumn("shift", F.max(F.when(F.col("version") == "v3", F.col("pct_of_mean"))).over(W.partitionBy("outcome", "level", "spec")) - F.max(F.when(F.col("version") == "none", F.col("pct_of_mean"))).over(W.partitionBy("outcome", "level", "spec")))
    return rounded(both.select("outcome", "level", "spec", "version", "pct_of_mean", "ci_low_pct", "ci_high_pct", "p", "n", "shift"), "pct_of_mean", "ci_low_pct", "ci_high_pct", "p", "shift")


@query
def holm_models(spark, sf_dir):
    """The step-down correction over the p-values of the whole grid."""
    return rounded(stats.holm(grid(spark, sf_dir).select(*GRID_KEY, "p"), ties=tuple(GRID_KEY)), "p", "p_holm")


@query
def hac_interaction_decade(spark, sf_dir):
    """Effect after 1973 within decades: recession x post beside recession x pre and post."""
    p = panel(spark, sf_dir).withColumns({"x_post": F.col("x") * F.col("post"), "x_pre": F.col("x") * (1 - F.col("post"))})
    return rounded(stats.hac(p, ["outcome"], "yq", ["post", "x_pre"], ["decade"], x="x_post").select("outcome", "coef", "se"), "coef", "se")


@query
def composition_hac(spark, sf_dir):
    """Effect of recession quarters on what the records are made of: counts, advertisers, long-running and sector shares."""
    names = [s.lower() for s, _ in SECTORS] + ["other"]
    parts = ["ads", "advertisers", "ads_per_advertiser", "long_running_share", *names]
    wide = composition_series(spark, sf_dir).join(sector_share_crosstab(spark, sf_dir), "yq")
    long = wide.select("yq", F.inline(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).cast("double").alias("y")) for c in parts])))
    p = with_state(spark, long).withColumn("x", F.col("state").cast("int"))
    out = stats.hac(p, ["outcome"], "yq").select("outcome", "coef", "se", "n", dist.normal_p_column(F.col("coef"), F.col("se")).alias("p"))
    return out.withColumns({c: F.round(c, 6) for c in ("coef", "se", "p")})


@query
def shift_share_pooled(spark, sf_dir):
    y = scores(spark, sf_dir).filter("total_words > 0").select("row_id", (100 * F.col("harvard_pos") / F.col("total_words")).alias("y"))
    parts = series.shift_share(with_state(spark, sectored(spark, sf_dir)).join(y, "row_id"))
    return rounded(series.pooled_shift_share(parts), "between", "within", "total", "mix_share")


@query
def rules_beyond_v2(spark, sf_dir):
    """Records of each decade that only the text rules find."""
    v = filters.versions(records(spark, sf_dir), BLOCKLIST, RULES, HEADER)
    return v.groupBy("decade").agg(F.count("*").alias("n"), F.count_if(F.col("v3") & ~F.col("v2")).alias("n_new"))


@query
def rule_excerpts(spark, sf_dir):
    """The first match of a rule group with 150 characters around it, for each record that has one."""
    found = X.excerpt(F.col("text"), "|".join(RULES["licence"]), 150)
    return records(spark, sf_dir).select("row_id", found.alias("excerpt")).filter("excerpt is not null")


@query
def audit_excerpts(spark, sf_dir):
    """What each record of the audit sample was hit by, and 600 characters from 150 ahead of it on."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    r = records(spark, sf_dir)
    drawn = sampling.audit(filters.rule_hits(r, RULES), list(RULES), 30, 314, known)
    text = X.normalized(F.col("text"))
    found = {k: "|".join(f"(?:{p})" for p in ps) for k, ps in RULES.items()}
    pick = lambda f: F.coalesce(*[F.when(F.col("rule") == k, f(p)) for k, p in found.items()])
    # The sample is at most 30 rows a rule.
    return r.join(F.broadcast(drawn), "row_id").select("rule", "row_id", pick(lambda p: F.regexp_extract(text, p, 0)).alias("matched"), pick(lambda p: X.excerpt_from(text, p)).alias("excerpt"))


@query
def blocklist_rederived(spark, sf_dir):
    """Names that the list finds as written, and all records under these names in any case."""
    return filters.rederived(records(spark, sf_dir), BLOCKLIST)


@query
def caught_by_reason(spark, sf_dir):
    """Non-ads by reason (toxic or not): how many there are, and how many no version finds."""
    reason = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("other").alias("reason"))
    rows = labelled(spark, sf_dir).filter("non_ad").join(reason, "row_id")
    return rows.groupBy("reason").agg(F.count("*").alias("non_ads"), F.count_if(~F.col("v3")).alias("missed"))


@query
def second_coder(spark, sf_dir):
    """The part of the stratified sample that a second person labels, in the order of a second seed."""
    drawn = sampling.stratified(filters.strata(records(spark, sf_dir), CUES), QUOTAS, 314)
    return sampling.simple_sample(drawn.select("row_id", "decade", "stratum"), 30, 2718)


@query
def drift_vs_gap(spark, sf_dir):
    p = panel(spark, sf_dir)
    means = p.groupBy("outcome", "decade").agg(F.avg("y").alias("m"))
    drift = means.groupBy("outcome").agg((F.max("m") - F.min("m")).alias("drift_range"), F.stddev_samp("m").alias("drift_sd"))
    return rounded(drift.join(series.gaps(p, ["outcome"], F.col("x") == 1).select("outcome", "pct_of_mean"), "outcome"), "drift_range", "drift_sd", "pct_of_mean")


@query
def vocab_bow(spark, sf_dir):
    tokens = records(spark, sf_dir).select("row_id", F.explode(X.topic_tokens(F.col("text"))).alias("word")).filter(~F.col("word").isin(lexicon.STOPWORDS))
    return words.vocabulary(tokens)


@query
def word_freq_by_decade(spark, sf_dir):
    return words.word_counts(records(spark, sf_dir), ["decade"]).filter("n >= 50")


@query
def fightin_words(spark, sf_dir):
    counts = stated_counts(spark, sf_dir).groupBy("decade", "recession", "word").agg(F.sum("n").alias("n"))
    return rounded(words.log_odds(counts), "delta", "z")


@query
def vocab_concentration(spark, sf_dir):
    return rounded(words.concentration(words.word_counts(records(spark, sf_dir), ["yq"])), "top_share")


def stated_counts(spark, sf_dir):
    """Word counts by quarter, decade and state, stored so that the texts are read once for all contrasts."""
    make = lambda: words.word_counts(with_state(spark, records(spark, sf_dir)).withColumnRenamed("state", "recession"), ["yq", "decade", "recession"])
    return ResultStore(spark).get("stated_counts", [f"{sf_dir}/documents.parquet"], {}, make)


def permutations(spark, sf_dir, times: int = 500):
    return rounded(words.permutation_max(stated_counts(spark, sf_dir), times=times), "max_z")


@query
def permutation_max_z(spark, sf_dir):
    """The largest absolute z of any word under 500 shuffles of the quarters' labels, and as observed (-1)."""
    return permutations(spark, sf_dir)


@query
def significant_words(spark, sf_dir):
    """Log odds of all words with their own p, count and decades, the 95th percentile of the shuffles' largest z, and whether a word goes beyond it."""
    counts = stated_counts(spark, sf_dir)
    limit = words.threshold(words.permutation_max(counts)).first().threshold
    odds = words.log_odds(counts.groupBy("decade", "recession", "word").agg(F.sum("n").alias("n")))
    seen = counts.groupBy("word").agg(F.sum("n").alias("n"), F.countDistinct("decade").alias("decades"))
    out = odds.join(seen, "word").withColumn("threshold", F.lit(limit)).withColumn("significant", F.abs("z") > F.col("threshold"))
    return rounded(out.withColumn("p", dist.normal_p_column(F.col("z"), F.lit(1.0))), "delta", "z", "p", "threshold")


TOPIC_BAGS = {"min_df": 5, "max_df": 0.5, "size": 5000, "every": 10}


def topic_fits(spark, sf_dir):
    """Vectors of the records to fit and of those held out, the vocabulary, and a function that fits several (topics, seed) together.

    All of it comes from the store while documents and settings are as they were.
    """
    store, inputs, held = ResultStore(spark), [f"{sf_dir}/documents.parquet"], {}

    def bagged():
        if not held:
            # Every pass reads the vectors, so they are dealt evenly, however few files or row groups the documents have.
            even = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id")
            fit, rest = topics.split(records(spark, sf_dir).select("row_id", "yq", "text"), every=TOPIC_BAGS["every"])
            fit, model = topics.bags(fit, TOPIC_BAGS["min_df"], TOPIC_BAGS["max_df"], TOPIC_BAGS["size"])
            held["fit"], held["rest"] = even(fit), even(topics.halves(rest, model))
            held["words"] = spark.createDataFrame(list(enumerate(model.vocabulary)), "i int, word string")
        return held

    fit, rest, words_ = (store.get(f"topic_{name}", inputs, TOPIC_BAGS, lambda name=name: bagged()[name]) for name in ("fit", "rest", "words"))
    vocabulary = [r.word for r in words_.orderBy("i").collect()]

    def fitted(wanted: list[tuple[int, int]]) -> dict:
        together = cache(lambda: dict(zip(wanted, topics.fits(fit, wanted))))  # when the first one is missed
        return {(k, seed): store.model("topic_weights", inputs, TOPIC_BAGS | {"k": k, "seed": seed}, lambda k=k, seed=seed: together()[k, seed], topics.LocalLDAModel.load) for k, seed in wanted}

    return fit, rest, vocabulary, fitted


@query
def topic_prevalence(spark, sf_dir):
    """Mean topic weights by quarter of all records, those held out of the fit too."""
    fit, rest, _, fitted = topic_fits(spark, sf_dir)
    return topics.prevalence(fitted([(10, 1)])[10, 1], fit.unionByName(rest.select(fit.columns)))


@query
def topic_stability(spark, sf_dir):
    """Fits with 10 and 20 topics and two seeds each: matched topics and their cosines, and for each number of topics the
    agreement of the records' strongest topics, the held-out perplexity (of the bound, and by completion) and the choice."""
    fit, rest, vocabulary, fitted = topic_fits(spark, sf_dir)
    pairs, judged = {}, {}
    models = fitted([(k, seed) for k in (10, 20) for seed in (1, 2)])
    for k in (10, 20):
        a, b = models[k, 1], models[k, 2]
        pairs[k] = topics.stability(a.topicsMatrix().toArray().T, b.topicsMatrix().toArray().T, vocabulary)
        judged[k] = topics.summary(pairs[k])
        judged[k]["agreement"] = topics.dominant_agreement(a, b, [p["other"] for p in pairs[k]], fit)
        for seed, model in ((1, a), (2, b)):
            judged[k][f"perplexity_{seed}"] = topics.perplexity(model, rest)
            judged[k][f"completion_{seed}"] = topics.completion_perplexity(model, rest)
    chosen = topics.best(judged)
    judgement = ["mean_cosine", "share_stable", "agreement", "perplexity_1", "perplexity_2", "completion_1", "completion_2"]
    rows = [(k, k == chosen, *[judged[k][j] for j in judgement], *p.values()) for k in pairs for p in pairs[k]]
    return spark.createDataFrame(rows, f"k int, chosen boolean, {', '.join(f'{j} double' for j in judgement)}, topic int, other int, cosine double, shared int, jaccard double, stable boolean")


STRUCTURAL = {"topics": 10, "rounds": 75, "tolerance": 1e-5, "min_df": 5, "max_df": 0.5, "size": 5000, "seed": 314}
DECADES = list(range(1980, 2020, 10))  # beside the first one, the 1970s


def structural_bags(spark, sf_dir, store: ResultStore) -> tuple[DataFrame, list[str]]:
    """Bags of the records that the filters keep, with recession and decades as covariates, and the vocabulary."""
    inputs = [f"{sf_dir}/documents.parquet"]
    kept = {k: STRUCTURAL[k] for k in ("min_df", "max_df", "size")}

    def rows():
        r = records(spark, sf_dir)
        flags = filters.version_columns(BLOCKLIST, RULES, HEADER)
        return with_state(spark, r.withColumns(flags).filter("not v2 and text <> ''"))

    make = lambda: topics.vocabulary_of_worded(rows(), **kept)
    vocabulary = [r.word for r in store.get("structural_vocabulary", inputs, kept, make).orderBy("index").collect()]
    covariates = {"recession": F.col("state").cast("int")} | {f"decade_{d}": F.col("decade") == d for d in DECADES}
    make = lambda: topics.counted(rows().select("row_id", structural.design(covariates).alias("x"), "text"), vocabulary)
    return store.get("structural_bags", inputs, kept | {"covariates": list(covariates)}, make), vocabulary


def structural_fit(spark, sf_dir) -> tuple[DataFrame, list[str], structural.Globals]:
    """Bags, vocabulary and the fitted model, from the store if documents and settings are as they were."""
    store = ResultStore(spark)
    bags, vocabulary = structural_bags(spark, sf_dir, store)

    def make():
        model = structural.fit(bags, len(vocabulary), STRUCTURAL["topics"], STRUCTURAL["rounds"], STRUCTURAL["tolerance"], STRUCTURAL["seed"])
        return structural.saved(spark, model)

    return bags, vocabulary, structural.loaded(store.get("structural_model", [f"{sf_dir}/documents.parquet"], STRUCTURAL, make))


@query
def structural_topics(spark, sf_dir):
    """The ten likeliest words of each topic of the structural model, with the rounds and the bound of its fit."""
    _, vocabulary, model = structural_fit(spark, sf_dir)
    rows = [(t, r, vocabulary[w], float(p[w]), len(model.bound), model.bound[-1]) for t, p in enumerate(model.beta) for r, w in enumerate(sorted(range(len(p)), key=lambda w: (-p[w], w))[:10], 1)]
    return spark.createDataFrame(rows, "topic int, rank int, word string, probability double, rounds int, bound double")


@query
def structural_effects(spark, sf_dir):
    """Effect of recession and decades on the share of each topic, by composition of 25 draws, with p of t(n - k)."""
    bags, _, model = structural_fit(spark, sf_dir)
    found = structural.effects(bags, model, ["constant", "recession", *[f"decade_{d}" for d in DECADES]], times=25, seed=STRUCTURAL["seed"])
    rows = [(r["topic"], r["term"], r["coef"], r["se"], dist.t_p(r["coef"] / r["se"], r["df"]) if r["se"] > 0 and r["df"] > 0 else None, r["n"]) for r in found]
    return spark.createDataFrame(rows, "topic int, term string, coef double, se double, p double, n bigint")


@query
def structural_quarterly(spark, sf_dir):
    """Mean shares by quarter on recession and decade: small-sample HAC errors, p of t, Holm over the topics, percentage points."""
    bags, _, model = structural_fit(spark, sf_dir)
    theta = structural.shares(bags, model)
    when = with_state(spark, records(spark, sf_dir).select("row_id", "yq", "decade"))
    long = theta.join(when, "row_id").select("yq", "decade", "state", F.posexplode("theta").alias("topic", "share"))
    p = long.groupBy("topic", "yq", "decade").agg(F.avg("share").alias("y"), F.max(F.col("state").cast("int")).alias("x"))
    out = stats.hac(p, ["topic"], "yq", within=["decade"], adjust=2 + len(DECADES))
    out = out.withColumn("p", dist.t_p_column("coef / se", f"n - {2 + len(DECADES)}"))
    out = stats.holm(out, ties=("topic",))
    return out.select("topic", (100 * F.col("coef")).alias("effect_pp"), (100 * F.col("se")).alias("se_pp"), (100 * (F.col("coef") - 1.96 * F.col("se"))).alias("low_pp"), (100 * (F.col("coef") + 1.96 * F.col("se"))).alias("high_pp"), "p", "p_holm", "n")


@query
def daily_events(spark, sf_dir):
    return daily(table(spark, sf_dir, "events"))


@query
def row_alignment(spark, sf_dir):
    """Share of rows of two files that agree on brand under the id and under the id less one."""
    a = records(spark, sf_dir).select("row_id", "brand")
    b = a.select((F.col("row_id") + 1).alias("label_id"), F.col("brand").alias("label_brand"))
    rate = lambda key: a.join(b, a["row_id"] == key).agg(F.avg((F.col("brand").eqNullSafe(F.col("label_brand"))).cast("double")).alias("rate"))
    return rounded(rate(F.col("label_id") - 1).withColumn("key", F.lit("less_one")).unionByName(rate(F.col("label_id")).withColumn("key", F.lit("same"))), "rate")


@query
def brand_counts(spark, sf_dir):
    return rounded(records(spark, sf_dir).groupBy("brand").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())), "share")


@query
def topic_overlap(spark, sf_dir):
    """Shared words and Jaccard similarity of the ten most frequent words of successive decades."""
    counts = words.word_counts(records(spark, sf_dir), ["decade"])
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("decade").orderBy(F.desc("n"), "word"))).filter("r <= 10").groupBy("decade").agg(F.collect_set("word").alias("words"))
    nxt = top.select((F.col("decade") - 10).alias("decade"), F.col("words").alias("later"))
    out = top.join(nxt, "decade").select("decade", F.size(F.array_intersect("words", "later")).cast("long").alias("shared"), (F.size(F.array_intersect("words", "later")) / F.size(F.array_union("words", "later"))).alias("jaccard"))
    return rounded(out, "jaccard")
