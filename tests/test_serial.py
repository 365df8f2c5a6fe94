"""p-values of the serial correlation test against dense eigenvalues and simulation."""

import math

import numpy as np
import pandas as pd
import pytest

from panelweave.models import diagnostics, serial
from panelweave.operators.panel import Panel


def second_differences(n):
    d = np.diff(np.eye(n), axis=0)
    return d.T @ d


def simulate(lengths, rho, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(lengths):
        u, e = rng.normal(), 0.0
        for t in range(n):
            x = rng.normal() + 0.1 * t
            e = rho * e + rng.normal()
            rows.append((i, 2000 + t + (t > 3), 1 + 0.5 * x + u + e, x, rng.normal()))
    return pd.DataFrame(rows, columns=["id", "t", "y", "x", "w"])


def dense_spectrum(a, x):
    """Eigenvalues of A on the complement of the regressors: no regressors are left."""
    q, _ = np.linalg.qr(x, mode="complete")
    rest = q[:, x.shape[1] :]
    values = np.linalg.eigvalsh(rest.T @ a @ rest)
    return serial.Spectrum(values, np.ones(len(values)), np.zeros((len(values), 0, 0)))


@pytest.fixture(scope="module")
def case(spark):
    data = simulate([3, 5, 5, 8, 8, 8, 2, 1, 6, 4, 7, 5], 0.2, 3)
    panel = Panel(spark.createDataFrame(data).repartition(3), "id", "t")
    frame, names = diagnostics.random_effects(panel, "y", ["x", "w"]).transformed(panel)
    rows = panel.on(frame)
    return panel, rows, names, frame.toPandas().sort_values(["id", "t"])


def test_spectrum_equals_dense_eigenvalues(case):
    panel, rows, names, local = case
    spectrum = serial.within_spectrum(rows, names)
    x = local[names].to_numpy()
    a = np.zeros((len(local), len(local)))
    for _, at in local.reset_index(drop=True).groupby("id").groups.items():
        a[np.ix_(at, at)] = second_differences(len(at))
    np.testing.assert_allclose(spectrum.products.sum(axis=0), x.T @ x, atol=1e-12)
    assert spectrum.counts.sum() == len(local)
    dense = dense_spectrum(a, x)
    for d in (0.2, 0.6, 1.0, 1.4, 1.7, 2.0, 2.5, 3.2):
        assert spectrum.mean(d) == pytest.approx((dense.values - d).sum())
        assert serial.ratio_tail(spectrum, d) == pytest.approx(serial.ratio_tail(dense, d), rel=1e-8, abs=1e-14)
    # Simulated residuals of the same regression.
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(x)
    u = rng.normal(size=(len(local), 200_000))
    e = u - q @ (q.T @ u)
    ratio = np.einsum("in,in->n", e, a @ e) / (e * e).sum(axis=0)
    for d in (0.8, 1.2, 1.6, 2.0):
        assert serial.ratio_tail(spectrum, d) == pytest.approx((ratio <= d).mean(), abs=0.005)


def test_ratio_tail_of_known_distributions():
    # Two chi-squares: the share of one is a beta variable.
    for m, n, d in ((4, 4, 0.5), (6, 2, 0.8), (2, 10, 0.02), (40, 40, 0.2), (3, 5, 0.999)):
        spectrum = serial.Spectrum(np.array([1.0, 0.0]), np.array([float(m), float(n)]), np.zeros((2, 0, 0)))
        steps = (np.arange(400_000) + 0.5) / 400_000 * d
        log = (m / 2 - 1) * np.log(steps) + (n / 2 - 1) * np.log1p(-steps)
        want = np.exp(log).sum() * d / 400_000 * math.exp(math.lgamma((m + n) / 2) - math.lgamma(m / 2) - math.lgamma(n / 2))
        assert serial.ratio_tail(spectrum, d) == pytest.approx(want, rel=1e-4)
    # Far out the probability stays precise in relative terms, and for millions of entities it is quick.
    tiny = serial.ratio_tail(serial.Spectrum(np.array([1.0, 0.0]), np.array([100.0, 100.0]), np.zeros((2, 0, 0))), 0.02)
    assert tiny == pytest.approx(2.9e-59, rel=0.2)
    many = serial.Spectrum(np.array([1.0, 0.0]), np.array([1e7, 1e7]), np.zeros((2, 0, 0)))
    assert serial.ratio_tail(many, 0.5) == pytest.approx(0.5, abs=1e-3)
    assert serial.ratio_tail(many, -0.1) == 0 and serial.ratio_tail(many, 1.1) == 1


def test_panel_p_value(case):
    panel, rows, names, local = case
    out = serial.durbin_watson_test(panel, "y", ["x", "w"])
    d = local.groupby("id").residual.diff().dropna()
    assert out["statistic"] == pytest.approx((d**2).sum() / (local.residual**2).sum())
    assert 0 < out["p_value"] < 1


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_stacked_frame(spark, case, parts):
    panel, rows, names, local = case
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = serial.stacked_sums(rows.df, ["id", "t"], ["residual", *names])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    z = local[["residual", *names]].to_numpy()
    a = second_differences(len(z))
    np.testing.assert_allclose(s.level, z.T @ z, atol=1e-12)
    np.testing.assert_allclose(s.step, z.T @ a @ z, atol=1e-12)
    np.testing.assert_allclose(s.bend, z.T @ a @ a @ z, atol=1e-12)


def test_pooled_p_value(spark):
    data = simulate([6] * 80, 0.1, 5)
    panel = Panel(spark.createDataFrame(data), "id", "t")
    out = serial.durbin_watson_test(panel, "y", ["x"], across_entities=True)
    frame, names = diagnostics.random_effects(panel, "y", ["x"]).transformed(panel)
    local = frame.toPandas().sort_values(["id", "t"])
    exact = dense_spectrum(second_differences(len(local)), local[names].to_numpy())
    stat, _ = diagnostics.durbin_watson(panel, "y", ["x"], across_entities=True)
    assert out["statistic"] == pytest.approx(stat)
    assert out["mean"] == pytest.approx(exact.values.mean())
    assert out["p_value"] == pytest.approx(serial.ratio_tail(exact, stat), abs=2e-3)
    strong = serial.durbin_watson_test(Panel(spark.createDataFrame(simulate([12] * 60, 0.7, 6)), "id", "t"), "y", ["x"])
    assert strong["p_value"] < 1e-6
