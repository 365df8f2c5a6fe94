"""Registered queries against their SQL, and the shape of their plans."""

import os
import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as contract  # noqa: E402
from compare import compare, oracle  # noqa: E402
from panelweave.queries import ORACLE, QUERIES  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402

FOLDER = os.environ.get("PANELWEAVE_TEST_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE.get(name))
    assert ok, text


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_contract_registers_all():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_capital_tables_read_the_lines_once(spark, monkeypatch):
    from panelweave.plans import trade_panel

    seen = []
    monkeypatch.setattr(trade_panel, "materialise", lambda df: seen.append(df._jdf.queryExecution().toString()) or df.persist())
    later = QUERIES["first_diff_export"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 1 and later.count("InMemoryTableScan") >= 1
    physical = seen[0].split("== Physical Plan ==")[1]
    assert physical.count("lineitem.parquet") == physical.count("orders.parquet") == 1


LAZY = [n for n in QUERIES if n not in {"mixture_classes", "yearly_files", "files_by_pattern", "csv_round_trip", "after_preamble", "grouped_by_triangle"} and not re.match("gmm|iv_|ols|fd|within|random|hc1|cluster|coef|model|resid|reduced|durbin|unit", n)]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cartesian_and_no_global_window(spark, name):
    df: DataFrame = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        assert "specifiedwindowframe" not in spec.split(",")[0], spec


def test_tables_laid_out_by_key_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = QUERIES["keyed_tables_join"](spark, FOLDER)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        by_key = joined.groupBy("cust", "year").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for p in (plan, by_key):
        assert "Exchange" not in p and p.count("SortMergeJoin") >= 4 and "Bucketed: true" in p
