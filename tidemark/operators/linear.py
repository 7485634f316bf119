"""Least squares with several regressors for every cell of a panel, without the driver.

One aggregate gives each cell's means and centred cross products; the inverse of their matrix is worked out by
elimination in a column of arrays, so cells may be many. A second aggregate over the rows gives residual sums and the
middle parts of robust covariances. Rows of one cell are a short series where HAC errors are asked for (they need
neighbours in order); the rest has no order and no window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import dist

#: A pivot (of the correlation matrix) below this means that a regressor is a mixture of others.
LEAST_PIVOT = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, vector))


def inverse(matrix: Column, size: int) -> Column:
    """Inverse of a symmetric positive matrix in an array of arrays, pivot by pivot in place; null if there is none."""

    def sweep(a: Column, t: Column) -> Column:
        pivot = F.get(F.get(a, t), t)
        pivot = F.when(pivot > LEAST_PIVOT, pivot)

        def cell(i: Column, row: Column):
            at = F.get(row, t)
            return lambda v, j: F.when((i == t) & (j == t), 1 / pivot).when(i == t, v / pivot).when(j == t, -at / pivot).otherwise(v - at * F.get(F.get(a, t), j) / pivot)

        return F.transform(a, lambda row, i: F.transform(row, cell(i, row)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, sweep)


def _square(values: list[list[Column]]) -> Column:
    return F.array(*[F.array(*row) for row in values])


def _symmetric(k: int, value) -> Column:
    """k x k array of value(i, j) with i <= j, worked out once for both places."""
    return _square([[value(min(i, j), max(i, j)) for j in range(k)] for i in range(k)])


def _sandwich(inner: Column, outer: Column, k: int) -> list[Column]:
    """Diagonal of outer * inner * outer."""
    return [dot(F.get(outer, F.lit(i)), times(inner, F.get(outer, F.lit(i)))) for i in range(k)]


def regress(panel: DataFrame, cell: list[str], xs: list[str], y: str = "y", order: str | None = None, lags: int = 4, level: float = 0.95) -> DataFrame:
    """One row for each cell and regressor: coef with classical, HC3 and (given an order) HAC errors, p and interval.

    Rows with a null in y or a regressor are left out. Columns of the whole model come with each row: n, intercept,
    r2, f, f_p (all slopes nothing), bp_lm, bp_lm_p, bp_f, bp_f_p (Breusch-Pagan). p-values are of t(n - k - 1),
    classical and HC3; those of HAC are of t as well. A cell whose regressors are collinear, or with too few rows,
    has nulls in place of estimates.
    """
    k, cells = len(xs), [F.col(c) for c in cell]
    names = [f"_x{i}" for i in range(k)]
    rows = panel.select(*cells, *([F.col(order).alias("_order")] if order else []), F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(n) for x, n in zip(xs, names)]).dropna(subset=["_y", *names])
    spread = rows.groupBy(*cell).agg(
        F.count("*").alias("n"),
        F.avg("_y").alias("_my"),
        F.array(*[F.avg(n) for n in names]).alias("_mx"),
        _symmetric(k, lambda i, j: F.covar_pop(names[i], names[j])).alias("_c"),
        F.array(*[F.covar_pop(n, "_y") for n in names]).alias("_cy"),
        F.var_pop("_y").alias("_vy"),
    )
    scale = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.sqrt(F.get(F.get("_c", i), i)))
    by_scale = lambda m: F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.try_divide(v, F.get("_s", i) * F.get("_s", j))))
    solved = spread.withColumn("_s", scale).withColumn("_inv", by_scale(inverse(by_scale(F.col("_c")), k)))
    # The inverse of the cross products themselves: that of the covariances over n.
    solved = solved.withColumn("_b", times(F.col("_inv"), F.col("_cy"))).withColumn("_inv", F.transform("_inv", lambda row: F.transform(row, lambda v: v / F.col("n")))).drop("_s")

    joined = rows.join(solved.select(*cell, "n", "_my", "_mx", "_inv", "_b"), cell)
    z = F.array(*[F.col(n) - F.get("_mx", F.lit(i)) for i, n in enumerate(names)])
    flat = joined.withColumn("_z", z).withColumn("_e", F.col("_y") - F.col("_my") - dot(F.col("_b"), F.col("_z"))).withColumn("_h", 1 / F.col("n") + dot(F.col("_z"), times(F.col("_inv"), F.col("_z"))))
    at = lambda i: F.get("_z", F.lit(i))
    loo = F.try_divide(F.col("_e"), 1 - F.col("_h"))
    sums = [F.sum(F.col("_e") * F.col("_e")).alias("_ssr"), _symmetric(k, lambda i, j: F.sum(at(i) * at(j) * loo * loo)).alias("_hc3")]
    sums += [F.array(*[F.covar_pop(n, F.col("_e") * F.col("_e")) for n in names]).alias("_ce"), F.var_pop(F.col("_e") * F.col("_e")).alias("_ve")]
    if order:
        w = W.partitionBy(*cell).orderBy("_order")
        flat = flat.withColumns({f"_u{i}": at(i) * F.col("_e") for i in range(k)})
        flat = flat.withColumns({f"_u{i}_{lag}": F.lag(f"_u{i}", lag).over(w) for i in range(k) for lag in range(1, lags + 1)})

        def long_run(i: int, j: int) -> Column:
            parts = [F.sum(F.col(f"_u{i}") * F.col(f"_u{j}"))]
            parts += [(1 - lag / (lags + 1)) * F.coalesce(F.sum(F.col(f"_u{i}") * F.col(f"_u{j}_{lag}") + F.col(f"_u{i}_{lag}") * F.col(f"_u{j}")), F.lit(0.0)) for lag in range(1, lags + 1)]
            return reduce(lambda a, b: a + b, parts)

        sums.append(_symmetric(k, long_run).alias("_hac"))
    out = flat.groupBy(*cell).agg(*sums).join(solved, cell)

    free = F.col("n") - k - 1
    part = lambda top, bottom: F.try_divide(top, bottom)
    r2 = 1 - part(F.col("_ssr"), F.col("n") * F.col("_vy"))
    out = out.withColumns({"_df": F.when(free > 0, free), "r2": r2, "intercept": F.col("_my") - dot(F.col("_b"), F.col("_mx"))})
    out = out.withColumn("_bp", part(dot(F.col("_ce"), times(F.col("_inv"), F.transform("_ce", lambda v: v * F.col("n")))), F.col("_ve")))
    out = out.withColumns({"f": part(F.col("r2") / k, (1 - F.col("r2")) / F.col("_df")), "bp_lm": F.col("n") * F.col("_bp"), "bp_f": part(F.col("_bp") / k, (1 - F.col("_bp")) / F.col("_df"))})
    out = out.withColumns({"f_p": dist.f_p_column("f", f"{k}", "_df"), "bp_lm_p": dist.chi2_p_column("bp_lm", f"{k}"), "bp_f_p": dist.f_p_column("bp_f", f"{k}", "_df"), "_t": dist.t_quantile_column("_df", level)})
    kinds = ["ols", "hc3", *(["hac"] if order else [])]
    variance = {"ols": [F.get(F.get("_inv", F.lit(i)), F.lit(i)) * F.col("_ssr") / F.col("_df") for i in range(k)]}
    variance |= {kind: _sandwich(F.col(f"_{kind}"), F.col("_inv"), k) for kind in kinds[1:]}
    terms = F.array(*[F.struct(F.lit(x).alias("term"), F.get("_b", F.lit(i)).alias("coef"), *[F.sqrt(variance[kind][i]).alias(f"se_{kind}") for kind in kinds]) for i, x in enumerate(xs)])
    model = ["n", "_df", "_t", "intercept", "r2", "f", "f_p", "bp_lm", "bp_lm_p", "bp_f", "bp_f_p"]
    long = out.select(*cell, *model, F.inline(terms))
    ps = {f"p_{kind}": dist.t_p_column(f"try_divide(coef, se_{kind})", "_df") for kind in kinds}
    sides = {"low": F.col("coef") - F.col("_t") * F.col("se_ols"), "high": F.col("coef") + F.col("_t") * F.col("se_ols")}
    return long.withColumns(ps | sides).select(*cell, "term", "coef", *[c for kind in kinds for c in (f"se_{kind}", f"p_{kind}")], "low", "high", *[m for m in model if not m.startswith("_")])
