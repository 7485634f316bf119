import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import lexicon, series
from tidemark.plans import oracle, queries

#: Text and the words that the boundary rules find in it, numbers and joiners alone left out.
BOUNDARIES = [
    ("Don't stop", ["don't", "stop"]),
    ("rock ’n’ roll, l’été", ["rock", "n", "roll", "l’été"]),
    ("'quoted' words'", ["quoted", "words"]),
    ("3.14 1,000 a1b2 4x4 5", ["a1b2", "4x4"]),
    ("e.g. U.S.A. end.", ["e.g", "u.s.a", "end"]),
    ("snake_case __init__ _", ["snake_case", "__init__"]),
    ("well-known co-op", ["well", "known", "co", "op"]),
    ("a:b c::d", ["a:b", "c", "d"]),
    ("naïve cafés", ["naïve", "cafés"]),
    ("co­op x‍y", ["co­op", "x‍y"]),
    ("日本語カタカナ", ["日", "本", "語", "カタカナ"]),
    ("can''t it.'s", ["can", "t", "it", "s"]),
    ("1.a a.1 7,b", ["a", "a", "b"]),
    ("", []),
    (" \n\t—…!", []),
    ("ab·cd price:5", ["ab·cd", "price"]),
]


def test_word_boundaries(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BOUNDARIES)] + [(99, None)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", X.boundary_tokens(F.col("t")).alias("w")).collect()}
    for i, (_, want) in enumerate(BOUNDARIES):
        assert got[i] == want, BOUNDARIES[i][0]
    assert got[99] is None


def test_variants_of_one_scan(spark):
    rows = spark.createDataFrame([(1, "The good of a gain and loss it's"), (2, ""), (3, "not bad, excellent!")], "row_id long, text string")
    both = lexicon.scored_variants(rows)
    for v in lexicon.VARIANTS:
        want = lexicon.scored(rows, variant=v)
        assert sorted(map(tuple, both.filter(F.col("variant") == v).drop("variant").collect())) == sorted(map(tuple, want.collect()))
    assert both.count() == 9


def test_a_series_finds_its_measure(spark):
    wide = spark.createDataFrame([("a", 1.0, 2.0, 1.0 + 1e-9), ("b", 3.0, 4.0, 9.0), ("c", None, 4.0, 1.0)], "yq string, x_ratio double, y_ratio double, z_ratio double")
    names = series.columns_by_suffix(wide, "_ratio")
    assert names == ["x_ratio", "y_ratio", "z_ratio"]
    stored = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "yq string, value double")
    got = {r.candidate: r for r in series.reproduced(wide.filter("yq <> 'c'"), names, stored).collect()}
    assert [got[n].chosen for n in names] == [True, False, False] and got["y_ratio"].max_error == 1.0 and got["z_ratio"].points == 2
    # x has no value for the third point and the series has none: that is no miss.
    assert series.reproduced(wide, ["x_ratio", "y_ratio"], stored).filter("chosen").first().candidate == "x_ratio"
    with pytest.raises(Exception, match="0 columns"):
        series.reproduced(wide, ["y_ratio"], stored).collect()
    with pytest.raises(Exception, match="2 columns"):
        series.reproduced(wide.withColumn("w_ratio", F.col("x_ratio")), ["x_ratio", "w_ratio"], stored).collect()


def test_literals_that_queries_and_sql_share():
    """Written out here once more, so that a wrong literal shows."""
    assert queries.QUOTAS[1940] == {"cue": 3, "long": 2, "other": 5}
    assert all(queries.QUOTAS[d] == {"cue": 5, "long": 5, "other": 10} for d in range(1950, 2020, 10)) and len(queries.QUOTAS) == 8
    assert "WHEN decade = 1940" in oracle._QUOTA
    assert [s for s, _ in queries.SECTORS] == ["North", "South", "West"] and queries.SALES_SHIFT == 8
    assert set(queries.RULES) == {"tombstone", "legal_notice", "financial_statement", "house", "editorial", "licence"}


def test_guards_change_nothing(spark):
    """any_of and normalized against the plain forms, on texts of pieces of the patterns."""
    import random

    from tidemark.operators.filters import CUES, RULES

    rng = random.Random(6)
    pieces = [p for ps in [*RULES.values(), CUES] for p in ps]
    plain = [X.literal_part(p) for p in pieces] + ["been sold", " ", "-\n", "\t", "  ", "shares have", "interim report 1984", "the united states ", "three months", "' review", "x", "\x0b", "a-  b", "or", "(", "%"]
    texts = ["".join(rng.choice(plain) + rng.choice(["", " ", "\n", "."]) for _ in range(rng.randrange(1, 6))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    groups = {**RULES, "odd": ["a|b", "x+y", "(?:u|v)w"], "cues": [c.replace(r"\b", "") for c in CUES]}
    got = df.select("i", *[X.any_of(F.col("t"), ps).alias(k) for k, ps in groups.items()], X.normalized(F.col("t")).alias("n"))
    want = df.select("i", *[F.col("t").rlike("|".join(f"(?:{p})" for p in ps)).alias(k) for k, ps in groups.items()], F.regexp_replace(F.regexp_replace(F.lower("t"), r"-\s+", ""), r"\s+", " ").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {k for k in RULES if got.filter(k).count()} == set(RULES)


@pytest.mark.parametrize("pattern, part", [("a|b", ""), ("ab(c|d)efg", "efg"), (r"foo\.bar", "foo.bar"), ("x{2}yz", "yz"), ("abc?d", "ab"), (r"\bword\b", "word"), ("a.bcd", "bcd"), ("[xy]zz*k", "z"), ("", "")])
def test_literal_parts(pattern, part):
    assert X.literal_part(pattern) == part
