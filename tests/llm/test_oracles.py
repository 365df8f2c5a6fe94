"""Queries with SQL, against DuckDB on the same tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import compare, oracle  # noqa: E402

import corpus_pipeline  # noqa: E402
from panelweave.llm.queries import ORACLE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


def test_names():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5 and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE))
def test_oracle(spark, name):
    ok, text = compare(spark, oracle(FOLDER), FOLDER, name, QUERIES[name], ORACLE[name])
    assert ok, text
