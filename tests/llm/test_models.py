"""The fitted models against finite differences and plain loops, and their odd inputs."""

import numpy as np
import pytest
from fixtures import SCHEMA, frame

from tidemark.llm import quality_pu, secrets, toxicity


class Still(quality_pu.Net):
    """Keeps what a step is asked to do, and does nothing."""

    def step(self, z, slope, rate):
        self.asked = getattr(self, "asked", []) + [(z, slope)]


def risk_parts(fp, fu, prior):
    """Positive part and negative part of the unbiased risk under the logistic loss."""
    loss = lambda f, sign: np.logaddexp(0, -sign * f).mean()
    return prior * loss(fp, 1), loss(fu, -1) - prior * loss(fp, -1)


@pytest.mark.parametrize("prior, side", [(0.2, "above"), (0.95, "below")])
def test_slopes_of_the_non_negative_risk(monkeypatch, prior, side):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(quality_pu, "EPOCHS", 1)
    p, u = rng.standard_normal((256, 5)) + 1, rng.standard_normal((256, 5))
    net = Still(np.concatenate([p, u]))
    net.parts[3][0] = 0.5 if side == "above" else -3.0
    if side == "below":  # unlabelled rows that look negative, positives that look positive
        net.out = lambda z: np.where(z[:, 0] > -99, 0, 0) + np.where(np.isin(z[:, 0], p[:, 0]), 4.0, -4.0)
    quality_pu._train(net, p, u, prior)
    z, slope = net.asked[0]
    f = net.out(z)
    fp, fu = f[:256], f[256:]
    assert (risk_parts(fp, fu, prior)[1] >= 0) == (side == "above")
    h = 1e-5
    for i in [0, 3, 100, 255, 256, 300, 511]:
        up, down = f.copy(), f.copy()
        up[i] += h
        down[i] -= h
        parts = [risk_parts(x[:256], x[256:], prior) for x in (up, down)]
        positive, negative = ((parts[0][k] - parts[1][k]) / (2 * h) for k in (0, 1))
        assert slope[i] == pytest.approx(positive + negative if side == "above" else -negative, abs=1e-8)


def test_backward_pass():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 6))
    net = quality_pu.Net(x, seed=3)
    slope = rng.standard_normal(40)
    before = [q.copy() for q in net.parts]
    total = lambda: float(slope @ net.out(x) + 0.5e-4 * ((net.parts[0] ** 2).sum() + (net.parts[2] ** 2).sum()))
    h, numeric = 1e-6, []
    for q in net.parts:
        flat, out = q.reshape(-1), []
        for i in range(len(flat)):
            was = flat[i]
            flat[i] = was + h
            a = total()
            flat[i] = was - h
            b = total()
            flat[i] = was
            out.append((a - b) / (2 * h))
        numeric.append(np.array(out).reshape(q.shape))
    net.step(x, slope, 0.0)  # the first step's mean of the gradients is a tenth of the gradient
    for got, want, q, old in zip(net.m, numeric, net.parts, before):
        assert np.allclose(got * 10, want, atol=1e-5) and np.array_equal(q, old)


def test_trees_take_the_best_cut(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 2)
    monkeypatch.setattr(toxicity, "DEPTH", 1)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 4))
    y = (x[:, 2] + 0.3 * rng.standard_normal(300) > 0.4).astype(float)
    trees = toxicity.Trees(x, y)
    f = np.full(300, trees.start)
    for tree in trees.trees:
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: B023, E731
        gains = {(j, k): score(m) + score(~m) - score(np.ones(300, bool)) for j in range(4) for k, edge in enumerate(trees.edges[j]) for m in [x[:, j] <= edge] if 8 <= m.sum() <= 292}
        best = max(gains.values())
        j, k, a, b, _ = tree[0]
        assert gains[j, k] == pytest.approx(best)
        m = x[:, j] <= trees.edges[j][k]
        for node, rows in ((a, m), (b, ~m)):
            assert tree[node][4] == pytest.approx(-g[rows].sum() / (h[rows].sum() + 1))
        f = f + toxicity.RATE * np.where(m, tree[a][4], tree[b][4])
    assert np.allclose(trees.raw(x), f)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, 400)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_equal_ids_ties_and_long_texts(spark, labels):
    rows = [(i, f"plain text number {i % 5} of the same kind " * (1 + i % 7), "", "", 0, "", 0.0, 0, "") for i in range(300)]
    rows += [(4, "another text of one id", "", "", 0, "", 0.0, 0, ""), (4, "another text of one id", "", "", 0, "", 0.0, 0, ""), (900, "word " * 400_000, "", "", 0, "", 0.0, 0, ""), (None, None, None, None, None, None, None, None, None)]
    docs = frame(spark, rows).repartition(4)
    for scored in (quality_pu.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        by_text = {}
        texts = {}
        for r in rows:
            texts.setdefault(r[0], set()).add(r[1])
        for r in got:
            if len(texts[r.doc_id]) == 1:
                by_text.setdefault(next(iter(texts[r.doc_id])), set()).add(round(r.score, 12))
        assert all(len(s) == 1 for s in by_text.values())  # equal texts, equal scores


def test_clashing_columns_of_secret_scans(spark):
    rows = [(1, "x password=abcdefghijkl1 y", 5, 6), (2, None, 7, 8), (3, "", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _clean int, _secrets int")
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "x [secret] y" and got[2].text is None and got[3]._clean == 9 and got[1]._secrets == 6
    assert secrets.secret_report(docs).count() == 3
    assert secrets.redact(spark.createDataFrame([], SCHEMA)).count() == 0
