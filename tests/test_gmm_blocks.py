"""GMM with instruments kept by period against the same models with a column per instrument."""

import numpy as np
import pandas as pd
import pytest

from panelweave.models import gmm as gm
from panelweave.operators.panel import Panel


def simulate(n, periods, seed, gaps=0.12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, y = rng.normal(), rng.normal()
        for t in range(periods):
            x, w = rng.normal() + 0.3 * a, rng.normal()
            y = 0.5 * y + x - 0.5 * w + a + 0.05 * t + rng.normal()
            if rng.random() > gaps:
                rows.append((i, 2000 + t, y, x if rng.random() > 0.02 else None, w))
    return pd.DataFrame(rows, columns=["id", "t", "y", "x", "w"])


@pytest.fixture(scope="module")
def panel(spark):
    return Panel(spark.createDataFrame(simulate(70, 8, 2)).repartition(4), "id", "t")


CASES = [
    dict(x=["x", "w"], gmm_lags=(2, 3), steps=2),
    dict(x=["x"], gmm_lags=(2, 99), steps=1),
    dict(x=["x"], gmm_lags=(2, 4), steps=1, robust=False),
    dict(x=["x"], gmm_lags=(3, 5), instruments=["w", ("x", 1)], steps=2, robust=False),
    dict(x=[("x", 1)], gmm_lags=(2, 4), transformation="ld", steps=2),
    dict(x=["x"], gmm_lags=(2, 3), transformation="ld", steps=1, effect="twoways"),
    dict(x=["x"], gmm_lags=(2, 3), transformation="ld", steps=2, effect="twoways", first_step="block"),
    dict(x=[], gmm_lags=(2, 4), steps=2, effect="twoways"),
]


@pytest.mark.parametrize("case", CASES)
def test_equals_dense_instruments(panel, case):
    dense = gm.gmm(panel, "y", collapse=False, dense_columns=10**6, **case)
    blocks = gm.gmm(panel, "y", collapse=False, dense_columns=0, **case)
    assert blocks.fit.terms == dense.fit.terms
    np.testing.assert_allclose(blocks.fit.beta, dense.fit.beta, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(blocks.fit.vcov, dense.fit.vcov, rtol=1e-6, atol=1e-10)
    np.testing.assert_allclose(blocks.one_step_robust, dense.one_step_robust, rtol=1e-6, atol=1e-10)
    assert (blocks.n_entities, blocks.n_instruments, blocks.weight_rank, blocks.fit.nobs) == (dense.n_entities, dense.n_instruments, dense.weight_rank, dense.fit.nobs)
    assert [t[0] for t in blocks.tests] == [t[0] for t in dense.tests]
    for a, b in zip(blocks.tests, dense.tests):
        np.testing.assert_allclose(a[1:], b[1:], rtol=1e-6, atol=1e-9)


def test_sixty_periods_with_all_lags(spark):
    panel = Panel(spark.createDataFrame(simulate(1800, 60, 7, gaps=0.05)).repartition(8), "id", "t")
    fit = gm.gmm(panel, "y", ["x", "w"], gmm_lags=(2, 99), steps=2, collapse=False)
    assert fit.n_instruments == 58 * 59 // 2 + 2 and fit.weight_rank == fit.n_instruments
    np.testing.assert_allclose(fit.fit.beta, [0.5, 1.0, -0.5], atol=0.03)
    rows = fit.fit.nobs
    assert rows > 80_000
