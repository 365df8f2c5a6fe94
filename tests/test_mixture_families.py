"""Mixtures with constrained covariances against EM in plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.models import mixture_families as mf


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    a = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 300)
    b = rng.multivariate_normal([4, 3], [[0.3, 0], [0, 0.2]], 200)
    d = pd.DataFrame(np.vstack([a, b]), columns=["x", "y"])
    d["g"] = [0] * 300 + [1] * 200
    return d


def plain_em(z, k, family, rounds):
    n, d = z.shape
    w, means, covs = np.full(k, 1 / k), np.array([[1.5 * ((2 * c + 1) / k - 1)] * d for c in range(k)]), np.array([np.eye(d)] * k)

    def likelihoods():
        p = np.zeros((n, k))
        for c in range(k):
            e = z - means[c]
            p[:, c] = w[c] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", e, np.linalg.inv(covs[c]), e)) / np.sqrt((2 * np.pi) ** d * np.linalg.det(covs[c]))
        return p

    for _ in range(rounds):
        p = likelihoods()
        r = p / p.sum(axis=1, keepdims=True)
        size = r.sum(axis=0)
        w = size / n
        means = (r.T @ z) / size[:, None]
        s = np.array([((z - means[c]) * r[:, [c]]).T @ (z - means[c]) for c in range(k)])
        if family == "EII":
            covs = np.array([np.trace(s.sum(axis=0)) / (n * d) * np.eye(d)] * k)
        elif family == "VII":
            covs = np.array([np.trace(s[c]) / (size[c] * d) * np.eye(d) for c in range(k)])
        elif family == "EEI":
            covs = np.array([np.diag(np.diag(s.sum(axis=0)) / n)] * k)
        elif family == "VVI":
            covs = np.array([np.diag(np.diag(s[c]) / size[c]) for c in range(k)])
        elif family == "EEE":
            covs = np.array([s.sum(axis=0) / n] * k)
        else:
            covs = np.array([s[c] / size[c] for c in range(k)])
    return np.log(likelihoods().sum(axis=1)).sum(), means, covs


def test_all_families_equal_plain_em(spark, rows):
    z = (rows[["x", "y"]] - rows[["x", "y"]].mean()) / rows[["x", "y"]].std(ddof=0)
    found = []
    for parts in (1, 7):
        _, models = mf.mixture_families(spark.createDataFrame(rows).repartition(parts), ["x", "y"], (1, 2, 3), tol=0.0, max_iter=6)
        found.append(models)
    assert [(m.k, m.family) for m in found[0]] == [(k, f) for k in (1, 2, 3) for f in mf.FAMILIES]
    for a, b in zip(*found):
        want, means, covs = plain_em(z.to_numpy(), a.k, a.family, 6)
        for m in (a, b):
            assert m.likelihood == pytest.approx(want, rel=1e-9)
            np.testing.assert_allclose(m.means, means, atol=1e-7)
            np.testing.assert_allclose(m.covs, covs, atol=1e-7)
    assert mf.parameters("VVV", 3, 2) == 2 + 6 + 9 and mf.parameters("EII", 1, 4) == 5


def test_best_model_finds_the_groups(spark, rows):
    classed, models = mf.mixture_families(spark.createDataFrame(rows), ["x", "y"])
    best = min(models, key=lambda m: m.bic(len(rows)))
    assert (best.k, best.family) == (2, "VVV")
    counts = {(r["g"], r["class"]): r["n"] for r in classed.groupBy("g", "class").agg(F.count("*").alias("n")).collect()}
    assert counts[0, 0] > 290 and counts[1, 1] > 190
    empty, none = mf.mixture_families(spark.createDataFrame(rows).filter("false"), ["x", "y"])
    assert empty.count() == 0 and none == []
    with pytest.raises(ValueError):
        mf.mixture_families(spark.createDataFrame(rows), ["x"], families=("XXX",))
