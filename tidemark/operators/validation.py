"""Label-based validation: confusion counts, rates, Wilson intervals, kappa, weighted estimates, join checks."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Z = 1.96


def confusion(rows: DataFrame, flag: str, positive: str) -> DataFrame:
    """tp, fp, fn, tn of a boolean flag against a boolean truth (a non-ad is positive)."""
    f, p = F.col(flag), F.col(positive)
    return rows.agg(F.count_if(f & p).alias("tp"), F.count_if(f & ~p).alias("fp"), F.count_if(~f & p).alias("fn"), F.count_if(~f & ~p).alias("tn"))


def confusion_by(rows: DataFrame, by: list[str], flag: str, positive: str) -> DataFrame:
    """The same counts for each group."""
    f, p = F.col(flag), F.col(positive)
    return rows.groupBy(*by).agg(F.count_if(f & p).alias("tp"), F.count_if(f & ~p).alias("fp"), F.count_if(~f & p).alias("fn"), F.count_if(~f & ~p).alias("tn"))


def rates(cells: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = F.try_divide
    n = tp + fp + fn + tn
    return cells.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "specificity": share(tn, tn + fp), "agreement": share(tp + tn, n), "residual": share(fn, fn + tn)})


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    p = F.try_divide(k, n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def kappa() -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return F.try_divide((tp + tn) / n - expected, 1 - expected)


def weighted_rates(rows: DataFrame, flag: str, positive: str, weight: str) -> DataFrame:
    w, f, p = F.col(weight), F.col(flag), F.col(positive)
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    return rows.agg(F.try_divide(total(f & p), total(p)).alias("recall"), F.try_divide(total(f & p), total(f)).alias("precision"), F.try_divide(total(p), F.sum(w)).alias("prevalence"))


class Carried:
    """Checks whose numbers are counted in the pass that uses the table, by an observation, and judged after it.

    Each rule is (name, aggregate, test of its value, hard). `watch` adds the aggregates to a frame; after an action on
    it `verdicts` gives PASS, WARN or FAIL by name and raises if a hard one failed. No rows are read a second time.
    """

    def __init__(self, rules: list[tuple[str, Column, Callable[[object], bool], bool]]) -> None:
        self.rules, self.observation = rules, Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *[metric.alias(name) for name, metric, _, _ in self.rules])

    def verdicts(self) -> list[tuple[str, str]]:
        """Fails as well where Spark needed no row of the frame and so counted none (a side of a join without any key)."""
        try:
            seen = self.observation.get
        except Py4JError as e:
            raise AssertionError(f"not counted: {', '.join(name for name, *_ in self.rules)}") from e
        return checks([(name, bool(test(seen[name])), hard) for name, _, test, hard in self.rules])


def single(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, with `_copies`: how many rows the key had (a check that wants one each can count them)."""
    first = [F.first(c).alias(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(*first, F.count("*").alias("_copies"))


def unique_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> tuple[DataFrame, Carried]:
    """A join whose right side must have each key once, and the checks to be judged after an action that uses its columns.

    The right side is grouped by the key for the join anyway; its largest group and null keys are observed on the way.
    """
    found = Carried([("repeated keys", F.max("_copies"), lambda n: n is None or n == 1, True), ("null keys", F.count_if(F.col(key).isNull()), lambda n: n == 0, True)])
    return left.join(found.watch(single(right, key)).drop("_copies"), key, how), found


def checks(results: list[tuple[str, bool, bool]]) -> list[tuple[str, str]]:
    """(name, passed, hard) as PASS, WARN or FAIL; any FAIL raises."""
    out = [(n, "PASS" if ok else "FAIL" if hard else "WARN") for n, ok, hard in results]
    if failed := [n for n, s in out if s == "FAIL"]:
        raise AssertionError(", ".join(failed))
    return out
