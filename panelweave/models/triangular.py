"""Rank of a regression by orthogonal triangles, without squaring the condition number.

Each task turns its rows into a triangle R with R'R = X'X, batch by batch; triangles are stacked and
turned into one again, first in a few tasks and then on the driver. Columns keep their order: one that earlier
columns explain up to the tolerance is aliased, as least squares programs have it, and takes no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

#: Share of a column's length that earlier columns must leave for it to count.
TOLERANCE = 1e-7
#: Tasks that merge triangles before the driver does.
MERGERS = 16


def _turned(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangular(df: DataFrame, columns: Sequence[str], intercept: bool = False) -> np.ndarray:
    """Upper triangle R of the columns (SQL expressions; after a constant with ``intercept``), R'R being their cross-products.

    Rows must be complete. Memory is a batch and a triangle per task, whatever the number of rows.
    """
    ship_package(df.sparkSession)
    p = len(columns) + intercept

    def cells(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], ["r"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        r = np.zeros((0, p))
        for b in batches:
            if b.num_rows:
                x = [np.ones(b.num_rows)] if intercept else []
                r = _turned(np.vstack([r, np.column_stack(x + [c.to_numpy(zero_copy_only=False) for c in b.columns])]))
        yield cells(r)

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        r = np.zeros((0, p))
        for b in batches:
            stack = b.column("r").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            if len(stack):
                r = _turned(np.vstack([r, stack]))
        yield cells(r)

    rows = df.selectExpr(*[f"CAST({c} AS DOUBLE) AS c_{i}" for i, c in enumerate(columns)])
    merged = rows.mapInArrow(of_rows, "r array<double>").repartition(MERGERS).mapInArrow(of_triangles, "r array<double>")
    parts = [np.array(r["r"]).reshape(-1, p) for r in merged.collect()]
    r = _turned(np.vstack([*parts, np.zeros((p, p))]))
    return r


def independent(r: np.ndarray, scale: np.ndarray | None = None, tolerance: float = TOLERANCE) -> list[int]:
    """Columns that earlier kept columns do not explain; ``scale`` replaces the columns' lengths in the comparison."""
    scale = np.linalg.norm(r, axis=0) if scale is None else scale
    basis = np.zeros((len(r), 0))
    kept = []
    for j in range(r.shape[1]):
        v = r[:, j].copy()
        for _ in range(2):
            v -= basis @ (basis.T @ v)
        size = np.linalg.norm(v)
        if size > tolerance * scale[j] and np.isfinite(size):
            basis = np.column_stack([basis, v / size])
            kept.append(j)
    return kept


def projected(r: np.ndarray, onto: Sequence[int], columns: Sequence[int]) -> np.ndarray:
    """Columns of ``r`` projected on the space of others."""
    q, _ = np.linalg.qr(r[:, list(onto)])
    return q @ (q.T @ r[:, list(columns)])
