"""Moment matrices: the data an estimator needs, as Spark aggregates.

Least squares, instrumental variables and their panel forms see the data only through means and
centred cross-products. These come from one partial-plus-final aggregate whose output does not grow
with the data; the small dense solves happen afterwards on numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import missing
from ..session import ship_package

#: Rows of a matrix product that one job accumulates; a wider one takes several jobs.
BLOCK = 2000
JVM_PRODUCTS = 120


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def moment_sql(columns: Sequence[str]) -> list[str]:
    """n, means m_i and centred cross-products s_i_j; merged with a stable updating formula."""
    out = ["count(1) AS n"] + [f"avg(`{c}`) AS m_{i}" for i, c in enumerate(columns)]
    for i, j in pairs(len(columns)):
        out.append(f"regr_sxy(`{columns[i]}`, `{columns[j]}`) AS s_{i}_{j}")
    return out


def group(df: DataFrame, by: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    """GROUP BY with aggregates given as SQL."""
    return df.groupBy(*by).agg(*[F.expr(a) for a in aggregates]) if by else df.selectExpr(*aggregates)


def number(v: float) -> str:
    """A double as SQL literal."""
    return f"({float(v)!r}D)" if np.isfinite(v) else f"CAST('{float(v)}' AS DOUBLE)"


def symmetric(values: dict, p: int, prefix: str = "s_") -> np.ndarray:
    out = np.zeros((p, p))
    for i, j in pairs(p):
        v = values[f"{prefix}{i}_{j}"]
        out[i, j] = out[j, i] = np.nan if v is None else v
    return out


@dataclass
class Moments:
    """Row count, means and centred cross-products of named columns."""

    names: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of_row(cls, names: Sequence[str], row: dict) -> "Moments":
        p = len(names)
        mean = np.array([np.nan if row[f"m_{i}"] is None else row[f"m_{i}"] for i in range(p)], dtype=float)
        return cls(list(names), int(row["n"]), mean, symmetric(row, p))

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(n) for n in names]

    def block(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        return self.cross[np.ix_(self.at(rows), self.at(cols))]

    def extend(self, name: str, weights: dict[str, float]) -> "Moments":
        """Add a column that is a linear combination of existing ones."""
        w = np.zeros(len(self.names))
        for k, v in weights.items():
            w[self.names.index(k)] = v
        c = self.cross @ w
        cross = np.block([[self.cross, c[:, None]], [c[None, :], np.array([[w @ c]])]])
        return Moments(self.names + [name], self.n, np.append(self.mean, w @ self.mean), cross)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments over complete, finite rows."""
    names = list(dict.fromkeys(columns))
    row = group(missing.finite_cases(df, names), (), moment_sql(names)).first().asDict()
    return Moments.of_row(names, row)


def gram(df: DataFrame, *terms: tuple[Sequence[str], Sequence[str]]) -> np.ndarray:
    """Sum over rows, and over the (left, right) terms, of left times right transposed.

    Sides are lists of SQL expressions; NULL counts as zero. Few products are plain JVM sums. Many
    are accumulated per task in a matrix product over Arrow batches, and the partial matrices are
    added by a grouped sum; the result is bounded by its dimension, whatever the number of rows.
    """
    a, b = len(terms[0][0]), len(terms[0][1])
    if a > BLOCK:
        return np.vstack([gram(df, *[(l[i : i + BLOCK], r) for l, r in terms]) for i in range(0, a, BLOCK)])
    if b > BLOCK:
        return np.hstack([gram(df, *[(l, r[i : i + BLOCK]) for l, r in terms]) for i in range(0, b, BLOCK)])
    if a * b * len(terms) <= JVM_PRODUCTS:
        cells = []
        for i in range(a):
            for j in range(b):
                total = " + ".join(f"coalesce(({l[i]}) * ({r[j]}), 0D)" for l, r in terms)
                cells.append(f"sum({total}) AS g_{i}_{j}")
        return np.array([0.0 if v is None else float(v) for v in df.selectExpr(*cells).first()]).reshape(a, b)

    ship_package(df.sparkSession)

    def partial(batches):
        total = np.zeros((a, b))
        for batch in batches:
            if batch.num_rows:
                for k in range(0, batch.num_columns, 2):
                    l = batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, a)
                    r = batch.column(k + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, b)
                    total += l.T @ r
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "v"]
        )

    dense = lambda side: "array(" + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0D)" for c in side) + ")"
    arrays = df.selectExpr(*[f"{dense(s)} AS s{k}_{n}" for k, t in enumerate(terms) for n, s in enumerate(t)])
    cells = arrays.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((a, b))
    for r in cells.collect():
        out[r["i"], r["j"]] = r["v"]
    return out
