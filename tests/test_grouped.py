"""Functions of groups by mergeable states."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.models import linear
from panelweave.operators import grouped
from panelweave.operators.grouped import Grouped, apply_grouped


def moments():
    """Count, mean and variance; nested functions travel to the tasks by value."""

    def merge(a, b):
        n = a[0] + b[0]
        if not n:
            return a
        d = b[1] - a[1]
        return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n

    def add(state, columns):
        v = columns["v"]
        return merge(state, (len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum())))

    return Grouped(lambda: (0, 0.0, 0.0), add, merge, lambda s: [(s[0], s[1], s[2] / (s[0] - 1))] if s[0] > 1 else [])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    g = np.where(rng.random(20_000) < 0.9, "hot", rng.integers(0, 300, 20_000).astype(str)).astype(object)
    g[:50] = None
    return pd.DataFrame({"g": g, "k": rng.integers(0, 2, 20_000), "v": rng.normal(5, 2, 20_000), "w": rng.normal(size=20_000)})


def test_user_statistic(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows).repartition(8)
    got = apply_grouped(df, ["g", "k"], ["v"], moments(), "n int, mean double, var double").toPandas()
    want = rows.groupby(["g", "k"], dropna=False).v.agg(["count", "mean", "var"]).reset_index().query("count > 1")
    both = got.merge(want, on=["g", "k"], how="outer")
    assert len(both) == len(want) == len(got) and got.n.dtype == np.int32
    np.testing.assert_allclose(both["mean_x"], both["mean_y"])
    np.testing.assert_allclose(both["var_x"], both["var_y"])


def test_hot_group_is_worked_on_by_all_tasks(spark, rows):
    df = spark.createDataFrame(rows).repartition(8)

    def add(state, columns):
        from pyspark import TaskContext

        return state | {TaskContext.get().partitionId(): state.get(TaskContext.get().partitionId(), 0) + len(columns["v"])}

    tasks = Grouped(dict, add, lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in a | b}, lambda s: [(len(s), max(s.values()), sum(s.values()))])
    hot = apply_grouped(df, ["g"], ["v"], tasks, "tasks int, most long, n long").filter("g = 'hot'").first()
    assert hot["tasks"] == 8 and hot["n"] == (rows.g == "hot").sum() and hot["most"] < hot["n"] / 6


def test_keys_of_many_kinds_and_no_rows(spark, monkeypatch):
    day = datetime.date(2020, 1, 2)
    data = [(day, 1, "a", 1.0), (day, 1, "a", 3.0), (None, 1, "a", 5.0), (None, 1, "a", 6.0), (day, 2, None, 7.0)]
    df = spark.createDataFrame(data, "d date, i int, s string, v double")
    count = Grouped(lambda: 0, lambda s, c: s + len(c["v"]), lambda a, b: a + b, lambda s: [(s, "x"), (-s, None)])
    monkeypatch.setattr(grouped, "HELD", 1)
    got = sorted(apply_grouped(df, ["d", "i", "s"], ["v"], count, "n long, note string").collect(), key=str)
    assert sorted((r["n"] for r in got)) == [-2, -2, -1, 1, 2, 2] and {r["d"] for r in got} == {day, None}
    assert apply_grouped(df.filter("false"), ["d"], ["v"], count, "n long, note string").count() == 0
    assert [r["n"] for r in apply_grouped(df, [], ["v"], count, "n long, note string").collect()] == [5, -5]


def test_regression_by_triangles(spark, rows):
    df = spark.createDataFrame(rows).repartition(8).withColumn("u", F.when(F.col("k") == 1, 2 * F.col("w") + 1).otherwise(F.col("w") * F.col("w")))
    some = df.filter("g in ('hot', '1', '2')")
    got = {(r["g"], r["k"], r["term"]): r for r in linear.grouped_by_triangle(some, ["g", "k"], "v", ["w", "u"]).collect()}
    for g in ("hot", "1", "2"):
        for k, x in ((0, ["w", "u"]), (1, ["w"])):
            fit = linear.ols(some.filter((F.col("g") == g) & (F.col("k") == k)), "v", x)
            for term, *values in fit.rows():
                r = got[g, k, term]
                np.testing.assert_allclose([r[c] for c in ("estimate", "std_error", "statistic", "p_value")], values, rtol=1e-7)
        assert got[g, 1, "u"]["estimate"] is None
