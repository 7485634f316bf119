import random
import re
import time

import pytest
from helpers import canonical
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import filters
from tidemark.plans import queries
from tidemark.plans.oracle import SQL
from tidemark.plans.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(name, spark, duck, sf_dir):
    got = REGISTRY[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert canonical(got[names].itertuples(index=False)) == canonical(want[names].itertuples(index=False))


def test_shuffles_against_sql(spark, duck, sf_dir):
    from tidemark.plans.oracle import FOUR_SHUFFLES
    from tidemark.plans.queries import permutations

    got = permutations(spark, sf_dir, 4).toPandas()
    want = duck.execute(FOUR_SHUFFLES).df()
    assert canonical(got[["max_z", "perm"]].itertuples(index=False)) == canonical(want[["max_z", "perm"]].itertuples(index=False))


def test_small_rules(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import text as X
    from tidemark.sources.tables import non_generic

    rows = spark.createDataFrame([(1, "Yes", True), (2, " FALSE", False), (3, "?", None), (4, None, False)], "i int, t string, is_generic boolean")
    assert [r[0] for r in rows.orderBy("i").select(X.as_boolean(F.col("t"))).collect()] == [True, False, None, None]
    assert [r.i for r in non_generic(rows).orderBy("i").collect()] == [2, 4]
    cut = spark.createDataFrame([("a" * 9 + "Balance sheet" + "b" * 9,), ("none",)], "t string").select(X.excerpt(F.col("t"), "balance sheet", 3).alias("x"))
    assert sorted(r.x or "" for r in cut.collect()) == ["", "aaaBalance sheetbbb"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries())


def test_excerpts_equal_the_plain_search(spark):
    """Each text against the search that begins at every place, in code points; matches near the start, twice, far off, in pairs."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "\n", "\U0001F600", "é", "Licensed under", "all RIGHTS reserved"][: 4 + 2 * (rng.random() < 0.5)]) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None, "x" * 40 + "licenced under"]
    pattern = "|".join(filters.RULES["legal_notice"] + ["all rights reserved", "licen[sc]ed under"])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for around in (0, 3, 20):
        plain = re.compile(rf"(?is).{{0,{around}}}(?:{pattern}).{{0,{around}}}", re.ASCII)
        want = {i: m[0] if t and (m := plain.search(t)) else None for i, t in enumerate(texts)}
        assert {r.i: r.x for r in df.select("i", X.excerpt(F.col("t"), pattern, around).alias("x")).collect()} == want


def test_excerpts_of_long_texts_do_not_search_from_every_place(spark):
    df = spark.createDataFrame([("ab cd " * 700_000 + "balance sheet",)], "t string")
    begin = time.monotonic()
    assert df.select(X.excerpt(F.col("t"), "balance sheet|net loss", 4000).alias("x")).first().x.endswith("cd balance sheet")
    assert time.monotonic() - begin < 15


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_scan_before_and_after_a_filter(spark, sf_dir, duck, tmp_path):
    """One scan of the documents; rows that share an id are paired as the statement's join does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert plan(REGISTRY["filter_before_after"](spark, sf_dir)).count(X.SCORING) == 1
    twice = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("text", F.lit("the worthless best one two three four five six seven eight"))).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    twice.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    cursor = duck.cursor()
    cursor.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = cursor.execute(SQL["filter_before_after"]).df()
    got = REGISTRY["filter_before_after"](spark, str(tmp_path)).toPandas()
    assert len(want) and canonical(got[sorted(got.columns)].itertuples(index=False)) == canonical(want[sorted(want.columns)].itertuples(index=False))


def test_flags_are_worked_out_once(spark, sf_dir):
    """A filter on the flags holds the normal form once, and the grid's scan tokenises once."""
    assert plan(REGISTRY["missed_by_reason"](spark, sf_dir)).count("lower(text") <= 1
    assert plan(queries.grouped_cells(spark, sf_dir)).count(X.SCORING) == 1


def test_has_words(spark):
    texts = ["", " ", "a", "a b", " a  b\tc ", "a b c", "x" * 50_000, "\u00a0 a b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[X.has_words(F.col("t"), n).alias(f"n{n}") for n in (1, 2, 3)], X.word_count(F.col("t")).alias("n")).collect()
    assert all(r[f"n{n}"] == (r.n >= n) for r in got for n in (1, 2, 3))
