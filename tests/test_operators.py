import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.functions import text as X
from tidemark.operators import cycle, filters, lexicon, linear, sampling, series, stats, topics, validation, words
from tidemark.sources.tables import checked, parsed_dates, read_csv, resolve_column, with_time, write_csv
from tidemark.streaming.incremental import daily


def one(df):
    return df.first()


def test_distributions():
    assert dist.normal_p(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert dist.t_p(0.2420716, 266) == pytest.approx(0.808911, abs=1e-4)
    assert dist.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.f_p(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.chi2_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)


def test_calendar_counts(spark):
    c = cycle.calendar(spark)
    assert c.count() == 268
    assert c.filter("recession_majority").count() == 42
    assert c.filter("recession_any").count() == 48


def test_technical_rule(spark):
    rows = spark.createDataFrame([("2000Q1", 10.0), ("2000Q2", 9.0), ("2000Q3", 8.0), ("2000Q4", 9.0), ("2001Q1", 8.5)], "yq string, value double")
    assert [r.technical for r in cycle.growth(rows).orderBy("yq").collect()] == [False, False, True, False, False]


def test_holm(spark):
    rows = spark.createDataFrame([(1, 0.001), (2, 0.02), (3, 0.03), (4, 0.5)], "id int, p double")
    assert [r.p_holm for r in stats.holm(rows).orderBy("id").collect()] == pytest.approx([0.004, 0.06, 0.06, 0.5])


@pytest.mark.parametrize(("cells", "recall", "kappa"), [((2, 0, 35, 163), 0.0541, 0.0852), ((24, 2, 13, 161), 0.6486, 0.7190)])
def test_confusion(spark, cells, recall, kappa):
    df = spark.createDataFrame([cells], "tp long, fp long, fn long, tn long")
    assert one(validation.rates(df)).recall == pytest.approx(recall, abs=1e-4)
    assert one(df.select(validation.kappa().alias("k"))).k == pytest.approx(kappa, abs=1e-4)


def test_wilson(spark):
    low, high = validation.wilson(F.lit(24), F.lit(37))
    r = one(spark.range(1).select(low.alias("a"), high.alias("b")))
    assert (r.a, r.b) == (pytest.approx(0.4876, abs=1e-4), pytest.approx(0.7817, abs=1e-4))


def test_zero_cells(spark):
    r = one(validation.rates(spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")))
    assert r.precision is None and r.recall is None and r.specificity == 1.0


def test_slope_is_gap_and_hac_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    n = 60
    x = (rng.random(n) < 0.3).astype(int)
    y = rng.normal(size=n) + 0.5 * x
    t = np.arange(n)
    rows = spark.createDataFrame([("a", f"{i:03d}", float(y[i]), int(x[i]), int(t[i])) for i in range(n)], "outcome string, yq string, y double, x int, t int")
    for controls, z in (([], np.ones((n, 1))), (["t"], np.column_stack([np.ones(n), t]))):
        r = one(stats.hac(rows, ["outcome"], "yq", controls))
        design = np.column_stack([x, z])
        inv = np.linalg.inv(design.T @ design)
        b = inv @ design.T @ y
        u = design * (y - design @ b)[:, None]
        s = u.T @ u
        for k in range(1, 5):
            g = u[k:].T @ u[:-k]
            s += (1 - k / 5) * (g + g.T)
        assert r.coef == pytest.approx(b[0], rel=1e-9)
        assert r.se == pytest.approx(np.sqrt((inv @ s @ inv)[0, 0]), rel=1e-9)
    gap = one(series.gaps(rows, ["outcome"], F.col("x") == 1)).gap
    assert one(linear.regress(rows, ["outcome"], ["x"])).coef == pytest.approx(gap, rel=1e-9)


def test_grouped_fixed_effects_equal_dummies(spark):
    """From sums over (cell, effect, cluster, x); the least-squares fit with all dummies is the judge."""
    rng = np.random.default_rng(5)
    n = 400
    g, year, x = rng.integers(0, 15, n), rng.integers(0, 12, n), rng.integers(0, 2, n)
    d = year // 4
    y = rng.normal(size=n) + 0.3 * x + 0.1 * g + 0.5 * d
    z = rng.normal(size=n)
    rows = spark.createDataFrame([("c", f"b{a}", int(b), int(c), int(e), float(f), float(h)) for a, b, c, e, f, h in zip(g, d, year, x, y, z)], "cell string, brand string, decade int, year int, x int, y double, z double")
    sums = rows.groupBy("cell", "brand", "decade", "year", "x").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("z").alias("z"))
    # Levels without rows (7, 8) drop out.
    found = {r["outcome"]: r for r in stats.absorbed_sums(sums, "cell", "brand", "year", ["y", "z"], dummies="decade", levels=(0, 1, 2, 7, 8))}
    design = np.column_stack([x, *[(g == k) for k in range(15)], *[(d == k) for k in range(1, 3)]]).astype(float)
    inv = np.linalg.inv(design.T @ design)
    for name, values in (("y", y), ("z", z)):
        b = inv @ design.T @ values
        e = values - design @ b
        meat = sum(np.outer(v, v) for k in range(12) for v in [design[year == k].T @ e[year == k]])
        assert found[name]["coef"] == pytest.approx(b[0], rel=1e-8)
        assert found[name]["se"] == pytest.approx(np.sqrt((inv @ meat @ inv)[0, 0] * 12 / 11), rel=1e-8)
        assert found[name]["mean_y"] == pytest.approx(values.mean()) and found[name]["n"] == n and found[name]["clusters"] == 12
    empty = stats.absorbed_sums(sums.limit(0), "cell", "brand", "year", ["y", "z"])
    assert empty == []


def test_normal_p_column(spark):
    z = [0.0, 0.3, -1.96, 2.5, 5.0, 8.0, 40.0]
    got = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(z)] + [(99, 1.0, 0.0)], "i int, z double, se double").select("i", dist.normal_p_column(F.col("z"), F.col("se")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got[:-1]] == pytest.approx([dist.normal_p(v) for v in z], abs=1e-9)
    assert got[-1].p is None


def test_shift_share_adds_up(spark):
    rows = [(1970, "a", True, 1.0), (1970, "a", False, 2.0), (1970, "b", True, 3.0), (1970, "b", True, 5.0), (1980, "a", True, 1.0)]
    parts = series.shift_share(spark.createDataFrame(rows, "decade long, sector string, state boolean, y double"))
    r = parts.collect()
    assert len(r) == 1 and r[0].total == pytest.approx(3.0 - 2.0) and r[0].between + r[0].within == pytest.approx(r[0].total)
    assert one(series.pooled_shift_share(parts)).total == pytest.approx(1.0)


def test_matching_is_best():
    rng = np.random.default_rng(3)
    for _ in range(20):
        gain = rng.random((5, 5))
        m = topics.match(gain)
        best = max(sum(gain[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
        assert sum(gain[i, m[i]] for i in range(5)) == pytest.approx(best)


def test_stability_of_a_permuted_copy():
    phi = np.random.default_rng(4).random((4, 30))
    out = topics.stability(phi, phi[[2, 0, 3, 1]], [f"w{i}" for i in range(30)])
    assert all(r["cosine"] == pytest.approx(1.0) and r["stable"] and r["jaccard"] == 1.0 for r in out)


def test_lexicons(spark):
    wide = spark.createDataFrame([("ABLE", "x", None), ("Bad#1", None, "y"), (None, "x", "y")], "Entry string, Pos string, Neg string")
    assert sorted(map(tuple, lexicon.from_wide(wide, "Entry", "h", False).collect())) == [("h", "Neg", "bad#1"), ("h", "Pos", "able")]
    years = spark.createDataFrame([("GAIN", 2009, 0), ("LOSS", -2020, 2009)], "Word string, Positive int, Negative int")
    assert sorted(map(tuple, lexicon.from_wide(years, "Word", "l", True).collect())) == [("l", "Negative", "loss"), ("l", "Positive", "gain")]


def test_scores_and_tokens(spark):
    rows = spark.createDataFrame([(1, "don't THE the 12"), (2, ""), (3, "99")], "row_id long, text string")
    got = {r.row_id: r for r in lexicon.scored(rows).collect()}
    assert (got[1].total_words, got[1].harvard_pos, got[2].total_words, got[3].harvard_pos) == (3, 2, 0, 0)
    assert one(spark.range(1).select(X.contrast_tokens(F.lit("Don't na abc")).alias("t"))).t == ["don", "abc"]
    assert one(spark.range(1).select(X.topic_tokens(F.lit("Don't naïve Abc a_b")).alias("t"))).t == ["don", "abc"]


@pytest.mark.parametrize(("name", "key"), [("Barclays Bank, Limited", "barclays bank"), ("The Co.", "the co."), ("A & B plc", "a b")])
def test_brand_keys(spark, name, key):
    assert one(spark.range(1).select(X.brand_key(F.lit(name)).alias("k"))).k == key


def test_sector_rules_take_the_first(spark):
    rules = [("Air", ["air", "airline*"]), ("Bank", ["bank"])]
    got = [one(spark.range(1).select(X.first_rule(F.lit(k), rules).alias("s"))).s for k in ("bank of air", "airlines", "fair bank", "x")]
    assert got == ["Air", "Air", "Bank", "Other"]


@pytest.mark.parametrize(("rule", "text"), [("tombstone", "This is a Matter  of record"), ("legal_notice", "Notice is here-\nby given"), ("financial_statement", "interim report 1988"), ("house", "Sub-\nscription service"), ("editorial", "Also in this section")])
def test_rules(spark, rule, text):
    rows = spark.createDataFrame([(1, 1970, text)], "row_id long, decade long, text string")
    r = one(filters.rule_hits(rows, filters.RULES))
    assert [k for k in filters.RULES if r[f"rule_{k}"]] == [rule]


def test_versions_hold_each_other_and_flags(spark):
    rows = spark.createDataFrame([(1, "Bad", 1970, "w " * 20), (2, "bad ", 1970, "w " * 20), (3, None, 1970, "short"), (4, "ok", 1970, "published by order of " * 5), (5, "ok", 1970, "w " * 20)], "row_id long, brand string, decade long, text string")
    got = [(r.v1, r.v2, r.v3) for r in filters.versions(rows, ["Bad"], filters.RULES).orderBy("row_id").collect()]
    assert got == [(True,) * 3, (False, True, True), (True,) * 3, (False, False, True), (False,) * 3]
    assert [r.any_flag for r in filters.flags(rows, ["Bad"]).orderBy("row_id").collect()] == [True, False, True, False, False]


def test_sample_weights_add_up(spark):
    rows = spark.range(500).select(F.col("id").alias("row_id"), (1970 + F.pmod("id", F.lit(3)) * 10).alias("decade"), F.when(F.pmod("id", F.lit(7)) == 0, "cue").otherwise("other").alias("stratum"))
    quotas = {1970: {"cue": 5, "other": 10}, 1980: {"cue": 1, "other": 200}, 1990: {"cue": 2, "other": 1}}
    drawn = sampling.stratified(rows, quotas, 1, rows.filter("row_id < 50"))
    assert one(drawn.agg(F.sum("weight").alias("w"))).w == pytest.approx(450)
    assert drawn.filter("row_id < 50").count() == 0
    sizes = {(r.decade, r.stratum): r["count"] for r in drawn.groupBy("decade", "stratum").count().collect()}
    assert sizes[1980, "cue"] == 1 and sizes[1990, "other"] == 1 and sizes[1970, "other"] == 10 and sizes[1980, "other"] > 100
    assert sampling.stratified(rows, {1970: {"cue": 3}}, 1).count() == 3


def test_no_cell_is_sorted_whole(spark):
    """Tasks keep at most the limit of a cell before the shuffle."""
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.pmod("id", F.lit(2)).alias("cell"))
    low = sampling.lowest(rows, ["cell"], [sampling.hash_order(1, "row_id")], 7)
    plan = low._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and low.count() == 14


def test_validated_join_and_checks(spark):
    a, b = spark.range(3), spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string")
    joined, found = validation.unique_join(a, b, "id")
    joined.collect()
    with pytest.raises(AssertionError, match="repeated keys"):
        found.verdicts()
    joined, found = validation.unique_join(a, b.limit(1), "id")
    assert len(joined.collect()) == 3 and found.verdicts() == [("repeated keys", "PASS"), ("null keys", "PASS")]
    for rows, said in (([(None, "x"), (2, "y")], "^null keys"), ([(None, "x")], "^not counted")):
        joined, found = validation.unique_join(a, spark.createDataFrame(rows, "id long, v string"), "id")
        joined.collect()
        with pytest.raises(AssertionError, match=said):
            found.verdicts()
    with pytest.raises(AssertionError):
        validation.checks([("soft", False, False), ("hard", False, True)])


def test_checks_ride_on_the_pass(spark, tmp_path):
    """The plan of a checked join scans and shuffles no more than that of the join."""
    spark.range(50).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/a")
    spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v")).write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    joined, _ = validation.unique_join(a, b, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_permutations_agree_with_log_odds(spark):
    rows = [(f"{y}Q{q}", y // 10 * 10, q == 1 and y % 2 == 0, w, (y * q * (i + 3)) % 17 + 30) for y in range(1970, 1990) for q in (1, 2, 3, 4) for i, w in enumerate(("aaa", "bbb", "ccc"))]
    counts = spark.createDataFrame(rows, "yq string, decade long, recession boolean, word string, n long")
    z = words.log_odds(counts.groupBy("decade", "recession", "word").agg(F.sum("n").alias("n")))
    top = one(z.agg(F.max(F.abs("z")).alias("m"))).m
    maxima = words.permutation_max(counts, times=30)
    assert one(maxima.filter("perm = -1")).max_z == pytest.approx(top, rel=1e-9)
    assert maxima.count() == 31 and one(words.threshold(maxima)).threshold > 0


def test_csv_round_trip_and_guards(spark, tmp_path):
    rows = spark.createDataFrame([(1, "1950-01-02", "B", False, 'line\n"two"'), (2, "no date", None, None, "x")], "row_id long, issue_date string, brand string, is_generic boolean, text string")
    write_csv(rows, str(tmp_path / "r"))
    back = with_time(parsed_dates(read_csv(spark, str(tmp_path / "r")))).orderBy("row_id").collect()
    assert back[0].text == 'line\n"two"' and back[0].yq == "1950Q1" and back[0].decade == 1950 and back[1].issue_date is None
    with pytest.raises(ValueError):
        checked(rows, "missing")
    assert resolve_column(rows, ["a", "brand"]) == "brand"


def test_stream_gives_what_the_table_gives(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    import shutil
    import tempfile

    folder = tempfile.mkdtemp()
    shutil.copy(f"{sf_dir}/events.parquet", f"{folder}/e.parquet")
    q = daily(spark.readStream.schema(schema).parquet(folder)).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily(spark.read.parquet(f"{sf_dir}/events.parquet")).collect()))


def test_holm_covers_all_rows(spark):
    rows = spark.range(1, 251).selectExpr("id AS s_suppkey", "pmod(id * 37, 101) / 5000 AS p")
    got = {r.s_suppkey: r.p_holm for r in stats.holm(rows, ties=("s_suppkey",)).collect()}
    want, top = {}, 0.0
    for i, (p, k) in enumerate(sorted((k * 37 % 101 / 5000, k) for k in range(1, 251))):
        top = max(top, (250 - i) * p)
        want[k] = min(1.0, top)
    assert got == pytest.approx(want, abs=1e-9)


def test_permutations_in_blocks_of_words(spark, monkeypatch):
    """Blocks of a few words give what one block gives, whatever quarters a word was seen in."""
    rng = np.random.default_rng(6)
    rows = [(f"{1980 + q // 4}Q{q % 4 + 1}", 1980 + q // 40 * 10, q % 5 == 0, f"w{w}", int(n)) for q in range(60) for w in range(40) if (n := rng.poisson(3))]
    counts = spark.createDataFrame(rows, "yq string, decade long, recession boolean, word string, n long").repartition(2)
    found = []
    for size in (7, 10**6):
        monkeypatch.setattr(words, "WORDS", size)
        found.append({r.perm: r.max_z for r in words.permutation_max(counts, times=20).collect()})
    assert found[0].keys() == set(range(-1, 20)) and all(found[0][k] == pytest.approx(found[1][k], rel=1e-12) for k in found[0])
