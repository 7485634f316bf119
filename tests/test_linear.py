import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.operators import linear


def test_distribution_columns(spark):
    rows = [(x, d1, d2) for x in (0.0, 1e-6, 0.3, 1.0, 2.2, 7.5, 40.0, 300.0) for d1 in (1, 2, 3, 10, 55) for d2 in (1, 2, 5, 30, 165, 2500)]
    df = spark.createDataFrame(rows, "x double, d1 int, d2 int")
    got = df.select("x", "d1", "d2", dist.t_p_column("x", "d2").alias("t"), dist.f_p_column("x", "d1", "d2").alias("f"), dist.chi2_p_column("x", "d1").alias("c")).collect()
    for r in got:
        assert r.t == pytest.approx(dist.t_p(r.x, r.d2), abs=1e-9)
        assert r.f == pytest.approx(dist.f_p(r.x, r.d1, r.d2), abs=1e-9)
        assert r.c == pytest.approx(dist.chi2_p(r.x, r.d1), abs=1e-9)
    lg = spark.createDataFrame([(0.5,), (1.0,), (3.25,), (80.0,), (4000.5,)], "x double").select("x", dist.log_gamma_column("x").alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in lg)


def test_quantiles_and_nulls(spark):
    df = spark.createDataFrame([(d,) for d in (1, 2, 3, 10, 30, 165, 4000)] + [(0,), (None,)], "d int")
    for level in (0.8, 0.95, 0.99):
        for r in df.select("d", dist.t_quantile_column("d", level).alias("q")).collect():
            assert r.q is None if not r.d else dist.t_p(r.q, r.d) == pytest.approx(1 - level, abs=1e-9)
    none = spark.createDataFrame([(None, 0)], "x double, d int").select(dist.t_p_column("x", "3"), dist.f_p_column("x", "2", "3"), dist.chi2_p_column("x", "2"), dist.t_p_column("1", "d")).first()
    assert list(none) == [None] * 4


def test_inverse(spark):
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 8):
        a = rng.standard_normal((k + 3, k))
        a = a.T @ a
        df = spark.createDataFrame([(a.tolist(),)], "m array<array<double>>")
        assert np.allclose(np.array(df.select(linear.inverse(F.col("m"), k)).first()[0]) @ a, np.eye(k), atol=1e-8)
    flat = spark.createDataFrame([([[1.0, 1.0], [1.0, 1.0]],)], "m array<array<double>>")
    assert flat.select(linear.inverse(F.col("m"), 2).alias("i")).first().i[0][0] is None


def brute(y, x, lags=4):
    n, k = x.shape
    full = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(full.T @ full)
    b = inv @ full.T @ y
    e = y - full @ b
    h = np.einsum("ni,ij,nj->n", full, inv, full)
    df = n - k - 1
    tss = ((y - y.mean()) ** 2).sum()
    r2 = 1 - e @ e / tss
    u = full * e[:, None]
    s = u.T @ u
    for lag in range(1, lags + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    errors = {"ols": e @ e / df * inv, "hc3": inv @ (full.T * (e / (1 - h)) ** 2) @ full @ inv, "hac": inv @ s @ inv}
    e2 = e * e
    g = full @ (inv @ full.T @ e2)
    bp = 1 - ((e2 - g) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    f, bp_f = (r2 / k) / ((1 - r2) / df), (bp / k) / ((1 - bp) / df)
    model = {"n": n, "intercept": b[0], "r2": r2, "f": f, "f_p": dist.f_p(f, k, df), "bp_lm": n * bp, "bp_lm_p": dist.chi2_p(n * bp, k), "bp_f": bp_f, "bp_f_p": dist.f_p(bp_f, k, df)}
    out = []
    for i in range(k):
        r = dict(model, coef=b[i + 1])
        for kind, v in errors.items():
            r[f"se_{kind}"] = math.sqrt(v[i + 1, i + 1])
            r[f"p_{kind}"] = dist.t_p(b[i + 1] / r[f"se_{kind}"], df)
        out.append(r)
    return out


def test_regressions_against_numpy(spark):
    rng, rows, want = np.random.default_rng(7), [], {}
    for c in range(4):
        n = 30 + 17 * c
        x = np.column_stack([rng.integers(0, 2, n), rng.standard_normal(n) * 1000 + 5000, np.arange(n), rng.standard_normal(n)]).astype(float)
        y = x @ [1.0, 0.002, -0.3, 0] + rng.standard_normal(n) * (1 + x[:, 0])
        rows += [(c, t, float(y[t]), *map(float, x[t])) for t in range(n)]
        want[c] = brute(y, x)
    rows += [(0, 900, None, 1.0, 1.0, 1.0, 1.0), (1, 901, 1.0, None, 1.0, 1.0, 1.0)]
    panel = spark.createDataFrame(rows, "cell int, t int, y double, a double, b double, c double, d double").repartition(5)
    got = linear.regress(panel, ["cell"], ["a", "b", "c", "d"], order="t").collect()
    assert len(got) == 16
    for r in got:
        expected = want[r.cell]["abcd".index(r.term)]
        for name, v in expected.items():
            assert r[name] == pytest.approx(v, rel=1e-7, abs=1e-9), name
        assert r.high - r.coef == pytest.approx(r.coef - r.low) and dist.t_p((r.high - r.coef) / r.se_ols, r.n - 5) == pytest.approx(0.05, abs=1e-8)


def test_collinear_short_and_empty(spark):
    rows = [(1, t, float(t), float(t), 2.0 * t) for t in range(9)] + [(2, t, float(t), float(t * t), 1.0 + t % 2) for t in range(3)]
    panel = spark.createDataFrame(rows, "cell int, t int, y double, a double, b double")
    got = {(r.cell, r.term): r for r in linear.regress(panel, ["cell"], ["a", "b"], order="t").collect()}
    assert got[1, "a"].coef is None and got[1, "a"].n == 9 and got[1, "b"].p_ols is None
    assert got[2, "a"].p_ols is None and got[2, "a"].coef is not None
    assert linear.regress(panel.limit(0), ["cell"], ["a", "b"], order="t").count() == 0
