"""Side-by-side tables of fitted models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .linear import Fit


def model_table(
    spark: SparkSession,
    models: Sequence[tuple[str, Fit] | tuple[str, Fit, np.ndarray]],
    groups: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per term, two columns (estimate, standard error) per model.

    A model may carry its own covariance matrix. ``groups`` prefixes the columns of its models.
    """
    label = {m: f"{g}_{m}" for g, ms in (groups or {}).items() for m in ms}
    rows = []
    for name, fit, *vcov in models:
        for term, est, se, _, _ in fit.rows(vcov[0] if vcov else None):
            rows.append((term, label.get(name, name), est, se))
    long = spark.createDataFrame(rows, "term string, model string, estimate double, std_error double")
    names = [label.get(m[0], m[0]) for m in models]
    aggs = []
    for n in names:
        aggs.append(F.max(F.when(F.col("model") == n, F.col("estimate"))).alias(f"{n}_estimate"))
        aggs.append(F.max(F.when(F.col("model") == n, F.col("std_error"))).alias(f"{n}_se"))
    return long.groupBy("term").agg(*aggs)


def summary_rows(models: Sequence[tuple[str, Fit]]) -> list[tuple[str, str, float]]:
    """(model, statistic, value) rows of the fit statistics."""
    return [(name, k, float(v)) for name, fit in models for k, v in fit.summary().items()]
