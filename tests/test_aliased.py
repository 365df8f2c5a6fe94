"""Aliased regressors and instruments: the rest equals the regression without them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.models import iv, linear, panel_models as pm
from panelweave.models.triangular import independent, triangular
from panelweave.operators.panel import Panel


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n, t = 40, 7
    d = pd.DataFrame({"id": np.repeat(np.arange(n), t), "t": np.tile(np.arange(2000, 2000 + t), n)})
    d["x"], d["w"], d["z"], d["z2"] = rng.normal(size=(4, n * t))
    d["x"] += 0.5 * d.z
    d["twice"] = 2 * d.x - 3 * d.w + 5
    d["fixed"] = d.id % 5 + 1e6
    d["year"] = d.t.astype(float)
    d["one"] = 7.0
    d["y"] = 1 + d.x - d.w + 0.1 * d.id + rng.normal(size=n * t)
    return d.drop(index=[3, 50, 51])


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(5)


def same(fit, reduced, gone, vcov=None, other=None):
    rows, want = fit.rows(vcov), {r[0]: r[1:] for r in reduced.rows(other)}
    assert [r[0] for r in rows if r[1] is None] == gone
    for r in rows:
        if r[0] in want:
            np.testing.assert_allclose(r[1:], want[r[0]], rtol=1e-7, atol=1e-10)
        else:
            assert r[1:] == (None,) * 4
    a, b = fit.summary(), reduced.summary()
    np.testing.assert_allclose(list(a.values()), list(b.values()), rtol=1e-7)


def test_triangle_has_the_cross_products(df, data):
    x = data[["x", "w", "z"]].to_numpy()
    r = triangular(df, ["x", "w", "z"])
    np.testing.assert_allclose(r.T @ r, x.T @ x)
    assert r.shape == (3, 3) and np.allclose(r, np.triu(r))
    assert triangular(df.filter("false"), ["x"], intercept=True).tolist() == [[0, 0], [0, 0]]
    near = df.selectExpr("x", "w", "x + 1e-6 * w AS near", "x + 1e-9 * w AS nearer")
    # Products of these columns differ in the twelfth digit only; the triangle still tells them apart.
    assert independent(triangular(near, ["x", "near", "nearer", "w"])) == [0, 1]
    assert independent(triangular(near, ["x", "nearer", "w"])) == [0, 2]


def test_pooled(df):
    full, reduced = linear.ols(df, "y", ["x", "w", "twice", "one", "z"]), linear.ols(df, "y", ["x", "w", "z"])
    same(full, reduced, ["twice", "one"])
    assert linear.ols(df, "y", ["twice", "x", "w"]).tidy(df.sparkSession).filter("estimate is null").collect()[0]["term"] == "w"
    (a, va), (b, vb) = linear.ols_robust(df, "y", ["x", "w", "twice", "z"]), linear.ols_robust(df, "y", ["x", "w", "z"])
    same(a, b, ["twice"], va, vb)
    left = a.with_residuals(df).agg(F.sum("residual"), F.sum(F.col("residual") ** 2)).first()
    assert left[0] == pytest.approx(0, abs=1e-8) and left[1] == pytest.approx(b.rss)


def test_grouped(df):
    rows = df.withColumn("g", F.col("id") % 3).withColumn("u", F.when(F.col("g") == 1, 2 * F.col("x") + 1).otherwise(F.col("z")))
    got = {(r["g"], r["term"]): r for r in linear.grouped_ols(rows, ["g"], "y", ["x", "u"], digits=None).collect()}
    assert got[1, "u"]["estimate"] is None and got[1, "u"]["p_value"] is None and len(got) == 9
    for g, x in ((0, ["x", "u"]), (1, ["x"]), (2, ["x", "u"])):
        fit, v = linear.ols_robust(rows.filter(F.col("g") == g), "y", x)
        for term, *values in fit.rows(v):
            np.testing.assert_allclose([got[g, term][c] for c in ("estimate", "std_error", "statistic", "p_value")], values, rtol=1e-7)


@pytest.mark.parametrize("effect,gone", [("individual", ["twice", "fixed"]), ("twoways", ["twice", "fixed", "year"])])
def test_within(df, effect, gone):
    panel = Panel(df, "id", "t")
    x = ["x", "twice", "w", "fixed", "year"]
    kept = [c for c in x if c not in gone and c != "w"] + ([] if "w" in gone else ["w"])
    full = pm.within(panel, "y", ["x", "w", "twice", "fixed", "year"], effect)
    reduced = pm.within(panel, "y", [c for c in ["x", "w", "year"] if c in kept], effect)
    same(full.fit, reduced.fit, gone, full.cluster_vcov(), reduced.cluster_vcov())
    a, b = (w.residuals().agg(F.sum(F.col("residual") ** 2)).first()[0] for w in (full, reduced))
    assert a == pytest.approx(b)


def test_instruments(df):
    panel = Panel(df, "id", "t")
    df = df.withColumn("z3", F.col("z") - F.col("z2"))
    full, reduced = iv.iv(df, "y", ["x"], ["w", "one"], ["z", "z2", "z3"]), iv.iv(df, "y", ["x"], ["w"], ["z", "z2"])
    same(full, reduced, ["one"])
    np.testing.assert_allclose([r[1:] for r in full.extra["diagnostics"]], [r[1:] for r in reduced.extra["diagnostics"]], rtol=1e-7)
    panel = Panel(df, "id", "t")
    for effect, gone in (("individual", ["fixed"]), ("twoways", ["fixed", "year"])):
        full = iv.iv_within(panel, "y", ["x"], ["w", "fixed", "year"], ["z", "z2", "z3"], effect)
        reduced = iv.iv_within(panel, "y", ["x"], ["w"] + ([] if effect == "twoways" else ["year"]), ["z", "z2"], effect)
        same(full, reduced, gone)
    full, reduced = iv.iv_first_difference(panel, "y", ["x"], ["w", "year"], ["z", "z2"]), iv.iv_first_difference(panel, "y", ["x"], ["w"], ["z", "z2"])
    same(full, reduced, ["year"])
    same(pm.first_difference(panel, "y", ["x", "fixed"]), pm.first_difference(panel, "y", ["x"]), ["fixed"])
