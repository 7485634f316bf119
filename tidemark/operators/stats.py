"""Regressions on panels of short series, all cells in one job, by partialling out (Frisch-Waugh-Lovell).

A panel has the cell's columns, an order column, y, x and controls. Controls are taken out of each other, of x
and of y in turn, after demeaning within the cell or within a fixed effect; what is left gives
coefficient and standard errors in scalar sums. Series are short (quarters), and cells many.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LAGS = 4


def partialled(panel: DataFrame, cell: list[str], controls: list[str] = (), within: list[str] = (), y: str = "y", x: str = "x") -> DataFrame:
    """panel with _y and _x: y and x without their parts explained by controls, an intercept or fixed effects."""
    group = W.partitionBy(*cell, *within)
    names = {v: f"_{i}" for i, v in enumerate(controls)} | {y: "_y", x: "_x"}
    out = panel.withColumns({n: F.col(v).cast("double") - F.avg(F.col(v).cast("double")).over(group) for v, n in names.items()})
    w = W.partitionBy(*cell)
    order = [*[names[c] for c in controls], "_x", "_y"]
    for i in range(len(controls)):
        c = F.col(order[i])
        out = out.withColumns({n: F.col(n) - F.coalesce(F.try_divide(F.sum(F.col(n) * c).over(w), F.sum(c * c).over(w)), F.lit(0.0)) * c for n in order[i + 1 :]})
    return out


def residuals(partial: DataFrame, cell: list[str]) -> DataFrame:
    """Adds _b (coefficient of x), _sxx and _e (residual)."""
    w = W.partitionBy(*cell)
    out = partial.withColumn("_sxx", F.sum(F.col("_x") * F.col("_x")).over(w)).withColumn("_b", F.sum(F.col("_x") * F.col("_y")).over(w) / F.col("_sxx"))
    return out.withColumn("_e", F.col("_y") - F.col("_b") * F.col("_x"))


def hac(panel: DataFrame, cell: list[str], order: str, controls: list[str] = (), within: list[str] = (), lags: int = LAGS, adjust: int = 0, y: str = "y", x: str = "x") -> DataFrame:
    """coef, se (Newey-West, Bartlett weights, no correction; adjust: k for the factor n / (n - k)), dw, n, mean_y."""
    r = residuals(partialled(panel, cell, controls, within, y, x), cell)
    seq = W.partitionBy(*cell).orderBy(order)
    u = r.withColumn("_u", F.col("_x") * F.col("_e")).withColumn("_d", F.col("_e") - F.lag("_e").over(seq))
    u = u.withColumns({f"_u{k}": F.col("_u") * F.lag("_u", k).over(seq) for k in range(1, lags + 1)})
    s = F.sum(F.col("_u") * F.col("_u"))
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_u{k}"), F.lit(0.0))
    n = F.count("*")
    factor: Column = n / (n - adjust) if adjust else F.lit(1.0)
    out = u.groupBy(*cell).agg(F.max("_b").alias("coef"), F.sqrt(s * factor / F.pow(F.max("_sxx"), F.lit(2))).alias("se"), (F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col("_e") * F.col("_e"))).alias("dw"), n.alias("n"), F.avg(F.col(y)).alias("mean_y"))
    return out.withColumn("pct_of_mean", 100 * F.col("coef") / F.col("mean_y"))


def absorbed_sums(sums: DataFrame, cell: str, effect: str, cluster: str, outcomes: list[str], x: str = "x", dummies: str | None = None, levels: tuple = (), k: int = 1) -> list[dict]:
    """Fixed-effect regressions of all outcomes and cells with clustered (CRV1) errors, from sums.

    Each row of `sums` stands for n records that share the cell, the effect, the cluster, x and the level of
    `dummies`, and has the sum of each outcome. So records are grouped once, before anything is shuffled by the
    effect, and one row for each cell and cluster reaches the driver. Means within an effect are an aggregate that
    is joined back: small effects (decades) are broadcast by Spark, large ones (advertisers) meet their few rows.
    """
    ys = [f"_y{j}" for j in range(len(outcomes))]
    fixed = {f"_d{i}": (F.col(dummies) == v).cast("double") for i, v in enumerate(levels)} | {"_x": F.col(x).cast("double")}
    base = sums.select(F.col(cell).alias("_cell"), F.col(effect).alias("_effect"), F.col(cluster).alias("_cluster"), F.col("n").cast("double").alias("_n"), *[c.alias(v) for v, c in fixed.items()], *[F.col(o).cast("double").alias(y) for o, y in zip(outcomes, ys, strict=True)])
    weighted = lambda total: (F.sum(total) / F.sum("_n"))
    means = base.groupBy("_cell", "_effect").agg(*[weighted(F.col(v) * F.col("_n")).alias(f"m{v}") for v in fixed], *[weighted(F.col(y)).alias(f"m{y}") for y in ys])
    means = means.select(F.col("_cell").alias("_mcell"), F.col("_effect").alias("_meffect"), *[f"m{v}" for v in [*fixed, *ys]])
    both = base.join(means, F.col("_cell").eqNullSafe(F.col("_mcell")) & F.col("_effect").eqNullSafe(F.col("_meffect")))
    flat = both.select("_cell", "_cluster", "_n", *[(F.col(v) - F.col(f"m{v}")).alias(v) for v in fixed], *[(F.col(y) - F.col("_n") * F.col(f"m{y}")).alias(y) for y in ys], *[F.col(y).alias(f"t{y}") for y in ys])
    names, d = list(fixed), len(levels)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    found: dict = {}
    cross = [F.sum(F.col("_n") * F.col(a) * F.col(b)) for a, b in pairs] + [F.sum(F.col(a) * F.col(y)) for y in ys for a in names] + [F.sum(f"t{y}") for y in ys]
    for cell_value, _, n, *values in flat.groupBy("_cell", "_cluster").agg(F.sum("_n"), *cross).collect():
        gram = np.zeros((d + 1, d + 1))
        for (a, b), v in zip(pairs, values, strict=False):
            gram[names.index(a), names.index(b)] = gram[names.index(b), names.index(a)] = v
        rest = np.array(values[len(pairs) :])
        found.setdefault(cell_value, []).append((n, gram, rest[: (d + 1) * len(ys)].reshape(len(ys), d + 1), rest[(d + 1) * len(ys) :]))
    out = []
    for cell_value, parts in found.items():
        n, g, gram = sum(p[0] for p in parts), len(parts), sum(p[1] for p in parts)
        solve = np.linalg.pinv(gram[:d, :d], rcond=1e-10, hermitian=True) if d else np.zeros((0, 0))
        # x without the dummies: the combination v of dummies and x.
        v = np.append(-solve @ gram[:d, d], 1.0)
        xx = v @ gram @ v
        for j, o in enumerate(outcomes):
            xy = sum(p[2][j] for p in parts)
            beta = v @ xy / xx
            # y less the dummies' part and beta x~, as a combination of dummies and x.
            c = np.append(solve @ xy[:d], 0.0) + beta * v
            scores = np.array([v @ p[2][j] - v @ p[1] @ c for p in parts])
            se = np.sqrt((scores @ scores) * g / (g - 1) * (n - 1) / (n - k)) / xx if g > 1 and n > k else float("nan")
            out.append({"cell": cell_value, "outcome": o, "coef": float(beta), "se": float(se), "n": int(n), "clusters": g, "mean_y": float(sum(p[3][j] for p in parts) / n)})
    return out


def holm(rows: DataFrame, p: str = "p", ties: tuple[str, ...] = ()) -> DataFrame:
    """Step-down adjusted p-values; equal ones are put in the order of `ties`."""
    up = W.orderBy(p, *ties)
    ranked = rows.withColumn("_i", F.row_number().over(up)).withColumn("_m", F.count("*").over(W.partitionBy()))
    return ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(up.rowsBetween(W.unboundedPreceding, 0)))).drop("_i", "_m")
