"""Two-way effects by conjugate gradients, against the direct solve and dummies."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from panelweave.models import panel_models as pm, two_way
from panelweave.operators.panel import Panel


def panel_of(spark, entities, periods, span, seed, spread=False):
    """Each entity sees ``span`` periods: neighbouring ones, or any with ``spread``."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(entities):
        at = rng.choice(periods, span, replace=False) if spread else rng.integers(0, periods - span + 1) + np.arange(span)
        rows += [(i, int(t)) for t in at]
    d = pd.DataFrame(rows, columns=["id", "t"])
    effect = np.cumsum(rng.normal(size=periods))
    d["x"] = rng.normal(size=len(d)) + 0.3 * effect[d.t] + d.id % 3
    d["y"] = 2 * d.x + effect[d.t] + d.id % 7 + rng.normal(size=len(d))
    return d, Panel(spark.createDataFrame(d).repartition(4), "id", "t")


@pytest.mark.parametrize("entities,periods,span,spread", [(60, 12, 5, True), (80, 30, 3, False), (40, 9, 9, False), (25, 40, 2, False)])
def test_equals_the_direct_solve(spark, monkeypatch, entities, periods, span, spread):
    d, panel = panel_of(spark, entities, periods, span, 3, spread)
    direct = pm.within(panel, "y", ["x"], "twoways")
    monkeypatch.setattr(pm, "DENSE_PERIODS", 0)
    graph = pm.within(panel, "y", ["x"], "twoways")
    np.testing.assert_allclose(graph.fit.beta, direct.fit.beta, rtol=1e-8)
    np.testing.assert_allclose(graph.fit.vcov, direct.fit.vcov, rtol=1e-8)
    assert graph.fit.df_resid == direct.fit.df_resid
    dummies = np.column_stack([d.x, pd.get_dummies(d.id).to_numpy(float), pd.get_dummies(d.t).to_numpy(float)[:, 1:]])
    b = np.linalg.lstsq(dummies, d.y.to_numpy(), rcond=None)[0]
    assert graph.fit.beta[0] == pytest.approx(b[0], rel=1e-7)


@pytest.mark.parametrize("entities,periods,span,spread,most", [(6000, 3000, 4, False, 120), (3000, 2000, 4, True, 120)])
def test_many_periods(spark, entities, periods, span, spread, most):
    d, panel = panel_of(spark, entities, periods, span, 5, spread)
    found = two_way.graph_effects(panel, ["x", "y"])
    assert found.products <= most and found.residual <= two_way.TOLERANCE
    # Left-over residuals of the normal equations, recomputed from the rows.
    e = found.frame.toPandas().set_index("t")
    for j, c in enumerate(["x", "y"]):
        net = d[c] - e[f"e_{j}"].loc[d.t].to_numpy()
        net -= net.groupby(d.id).transform("mean")
        start = (d[c] - d[c].groupby(d.id).transform("mean")).groupby(d.t).sum()
        assert abs(net.groupby(d.t).sum()).max() < 1e-8 * abs(start).max()
    assert pm.within(panel, "y", ["x"], "twoways").fit.beta[0] == pytest.approx(2, abs=0.1)


def test_constant_columns_need_no_search(spark):
    _, panel = panel_of(spark, 20, 8, 3, 1)
    flat = panel.on(panel.df.selectExpr("id", "t", "1.5D AS x"))
    assert two_way.graph_effects(flat, ["x"]).products == 0


def test_products_move_no_rows(spark, monkeypatch):
    """Rows meet by entity once; a product exchanges sums by place only."""
    _, panel = panel_of(spark, 200, 60, 4, 7, True)
    plans, to_arrow = [], type(panel.df).toArrow

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return to_arrow(df)

    monkeypatch.setattr(type(panel.df), "toArrow", planned)
    found = two_way.graph_effects(panel, ["x", "y"])
    assert found.products > 3
    for plan in plans[-found.products :]:
        assert re.findall(r"Exchange (\w+\(\w+)", plan) == ["hashpartitioning(place"], plan
        assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_lists_hold_whole_entities(size):
    lengths = [3, 1, 7, 1, 1, 4]
    at = np.concatenate([np.arange(1, n + 1) for n in lengths]).astype(np.int32)
    place = np.arange(len(at), dtype=np.int32)[::-1]
    rows = pa.table({"__place": place, "__at": at})
    out = list(two_way._by_entity(iter(rows.to_batches(max_chunksize=size))))
    assert np.concatenate([b.column("place").flatten() for b in out]).tolist() == place.tolist()
    assert np.concatenate([b.column("length").flatten() for b in out]).tolist() == lengths
    assert all(len(b.column("place").flatten()) == sum(b.column("length").flatten().to_pylist()) for b in out)
    assert list(two_way._by_entity(iter([]))) == []


def test_small_batches_and_a_null_entity(spark):
    d, panel = panel_of(spark, 50, 30, 6, 9, True)
    d["id"] = d.id.where(d.id != 7).astype("Int64")
    rows = [(None if r.id is pd.NA else int(r.id), int(r.t), float(r.x), float(r.y)) for r in d.itertuples()]
    missing = panel.on(spark.createDataFrame(rows, "id long, t long, x double, y double").repartition(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = two_way.graph_effects(missing, ["x", "y"]).frame.toPandas().set_index("t")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = two_way.graph_effects(panel, ["x", "y"]).frame.toPandas().set_index("t")
    for c in ("e_0", "e_1"):
        np.testing.assert_allclose(found[c] - found[c].mean(), (want[c] - want[c].mean()).loc[found.index], atol=1e-8)


def test_a_null_period_is_refused(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, 4.0), (2, None, 5.0)], "id long, t long, x double")
    with pytest.raises(ValueError):
        two_way.graph_effects(Panel(df, "id", "t"), ["x"])
