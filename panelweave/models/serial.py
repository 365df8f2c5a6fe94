"""p-values of the panel Durbin-Watson test.

The statistic is a ratio of quadratic forms in the residuals, e'Ae / e'e. With differences inside entities, A
depends on an entity's rows only through their number, and its eigenvectors are cosines. So the exact
distribution needs, per length and frequency, the number of entities and the summed products of the regressors'
cosine transforms: a table of at most periods x periods rows, whatever the number of entities. Along the whole
stacked frame the first two moments of the ratio give a normal approximation, from sums of first and second
differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import distributions as dist
from ..operators.panel import Panel
from ..session import materialise, ship_package
from .moments import group, pairs, symmetric
from .panel_models import random_effects


@dataclass
class Spectrum:
    """Eigenvalues of A, how many entities share each, and summed products of the regressors' transforms."""

    values: np.ndarray
    counts: np.ndarray
    products: np.ndarray  # [value, k, k]

    def log_function(self, at: float):
        """Logarithm of E exp(s (e'Ae - at e'e)) for the residuals of a regression, as a function of complex s.

        The determinant on the complement of the regressors is that of the whole times that of X'C^-1 X over X'X.
        """
        mu = self.values - at
        k = self.products.shape[1]
        flat = self.products.reshape(len(mu), k * k)
        half = np.linalg.inv(np.linalg.cholesky(flat.sum(axis=0).reshape(k, k))) if k else np.zeros((0, 0))

        def log_of(s: np.ndarray) -> np.ndarray:
            out = np.empty(len(s), complex)
            step = max(1, 4_000_000 // len(mu))
            for a in range(0, len(s), step):
                factor = 1 - 2 * s[a : a + step, None] * mu[None, :]
                # Every factor, and every eigenvalue of X'C^-1 X, has a positive real part: no branch is crossed.
                log = np.log(factor) @ self.counts
                if k:
                    inner = half @ ((1 / factor) @ flat).reshape(-1, k, k) @ half.T
                    log = log + np.log(np.linalg.eigvals(inner)).sum(axis=1)
                out[a : a + step] = -log / 2
            return out

        return log_of

    def mean(self, at: float) -> float:
        """Expectation of e'Ae - at e'e."""
        mu = self.values - at
        whole = self.products.sum(axis=0)
        lost = np.trace(np.linalg.solve(whole, np.tensordot(mu, self.products, 1))) if len(whole) else 0.0
        return float(mu @ self.counts - lost)


def ratio_tail(spectrum: Spectrum, at: float) -> float:
    """Probability that e'Ae / e'e is at most ``at``.

    The inversion integral runs along the vertical line through the saddle point, on the side of zero where the
    smaller tail lies, so small probabilities keep their relative precision.
    """
    low, high = float(spectrum.values.min()), float(spectrum.values.max())
    if at <= low or at >= high:
        return float(at >= high)
    log_of = spectrum.log_function(at)
    lower = spectrum.mean(at) > 0
    bound = 1 / (2 * (low - at)) if lower else 1 / (2 * (high - at))
    place = lambda v: bound / (1 + math.exp(v))
    height = lambda c: float(log_of(np.array([c + 0j]))[0].real) - math.log(abs(c))
    # The height is convex in c, so it has one minimum in v too; golden section.
    a, b, ratio = -40.0, 60.0, (math.sqrt(5) - 1) / 2
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    hx, hy = height(place(x)), height(place(y))
    while b - a > 1e-6:
        if hx <= hy:
            b, y, hy = y, x, hx
            x = b - ratio * (b - a)
            hx = height(place(x))
        else:
            a, x, hx = x, y, hy
            y = a + ratio * (b - a)
            hy = height(place(y))
    c = place((a + b) / 2)
    top = float(log_of(np.array([c + 0j]))[0].real)
    h = abs(c) * 1e-3
    bend = (height(c + h) + height(c - h) - 2 * height(c)) / h**2
    width = 1 / math.sqrt(max(bend, 1 / c**2))

    # Along y = width sinh(v) the trapezoid rule converges geometrically.
    total, v, dv, block = 0.0, 0.0, 1 / 32, 64
    while True:
        grid = v + dv * np.arange(block)
        s = c + 1j * width * np.sinh(grid)
        value = (np.exp(log_of(s) - top) / (-s if lower else s)).real * np.cosh(grid)
        if v == 0:
            value[0] /= 2
        total += float(value.sum())
        v += dv * block
        if np.abs(value[-8:]).max() < 1e-16 * max(abs(total), 1e-300) or v > 80:
            break
    tail = math.exp(top) * total * dv * width / math.pi
    tail = min(max(tail, 0.0), 1.0)
    return tail if lower else 1.0 - tail


def within_spectrum(rows: Panel, columns: Sequence[str]) -> Spectrum:
    """The spectrum for differences inside entities: one exchange by entity, then a small grouped sum.

    Each row meets the frequencies of its entity's length, so the work is rows times periods.
    """
    whole = Window.partitionBy(*rows.entity)
    placed = rows.df.select(*rows.entity, *columns, F.count(F.lit(1)).over(whole).alias("__n"), F.row_number().over(rows.window).alias("__at"))
    wave = placed.withColumn("__j", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))))
    weight = "(CASE WHEN __j = 0 THEN sqrt(1D / __n) ELSE sqrt(2D / __n) * cos(pi() * (__at - 0.5D) * __j / __n) END)"
    k = len(columns)
    each = group(wave, [*rows.entity, "__n", "__j"], [f"sum({weight} * `{c}`) AS d_{i}" for i, c in enumerate(columns)])
    table = group(each, ["__n", "__j"], ["count(1) AS c", *[f"sum(d_{i} * d_{j}) AS s_{i}_{j}" for i, j in pairs(k)]]).collect()
    values = np.array([2 - 2 * math.cos(math.pi * r["__j"] / r["__n"]) for r in table])
    products = np.array([symmetric(r.asDict(), k) for r in table]).reshape(len(table), k, k)
    return Spectrum(values, np.array([float(r["c"]) for r in table]), products)


# The stacked frame ---------------------------------------------------------------------------


@dataclass
class Stacked:
    """Sums over the rows of one long sequence: x x', (first differences)', (A x)(A x)'."""

    n: int
    level: np.ndarray
    step: np.ndarray
    bend: np.ndarray


def stacked_sums(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> Stacked:
    """Sums of products along the frame in ``order``.

    Rows are range-partitioned and sorted. A task adds up what lies inside its range and hands on its first
    and last two rows; the driver joins those ends, so it holds a few rows per task.
    """
    ship_package(df.sparkSession)
    p = len(columns)
    dealt = df.select(*order, *[F.col(f"`{c}`").cast("double").alias(f"c_{i}") for i, c in enumerate(columns)])
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(*[f"c_{i}" for i in range(p)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n, level, step, bend = 0, np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
        head, tail = np.zeros((0, p)), np.zeros((0, p))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)])
            n += len(x)
            level += x.T @ x
            head = np.vstack([head, x])[:2]
            # The last two rows of the batch before give its open differences.
            seen = np.vstack([tail, x])
            d = np.diff(seen, axis=0)
            new = d[max(len(tail) - 1, 0) :]
            step += new.T @ new
            a = d[:-1] - d[1:]
            bend += a.T @ a
            tail = seen[-2:]
        if n:
            flat = [level, step, bend, head, tail]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([n]), *[pa.array([v.ravel()], pa.list_(pa.float64())) for v in flat]],
                ["part", "n", "level", "step", "bend", "head", "tail"],
            )

    fields = "part long, n long, " + ", ".join(f"{c} array<double>" for c in ("level", "step", "bend", "head", "tail"))
    out = Stacked(0, np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p)))
    before: list[np.ndarray] = []
    for r in sorted(dealt.mapInArrow(walk, fields).collect(), key=lambda r: r["part"]):
        out.n += r["n"]
        for name in ("level", "step", "bend"):
            setattr(out, name, getattr(out, name) + np.array(r[name]).reshape(p, p))
        head, tail = (np.array(r[c]).reshape(-1, p) for c in ("head", "tail"))
        if before:
            d = head[0] - before[-1]
            out.step += np.outer(d, d)
            a = before[-1] - head[0] + (before[-1] - before[-2] if len(before) > 1 else 0)
            out.bend += np.outer(a, a)
        if len(head) > 1:
            a = head[0] - head[1] + (head[0] - before[-1] if before else 0)
            out.bend += np.outer(a, a)
        before = [*before, *tail][-2:]
    if len(before) > 1:
        a = before[-1] - before[-2]
        out.bend += np.outer(a, a)
    return out


def durbin_watson_test(panel: Panel, y: str, x: Sequence[str], across_entities: bool = False) -> dict:
    """Statistic and p-value against positive serial correlation of random-effects residuals.

    Inside entities the p-value is exact given the estimated weights: the ratio's distribution for normal errors and the quasi-
    demeaned regressors. ``across_entities`` takes differences along the whole frame in key order and a
    normal approximation by the ratio's mean and variance, as is usual from 100 rows on.
    """
    re = random_effects(panel, y, x)
    frame, regressors = re.transformed(panel)
    rows = panel.on(materialise(frame))
    k = len(regressors)
    if across_entities:
        s = stacked_sums(rows.df, [*rows.entity, rows.time], ["residual", *regressors])
        stat = float(s.step[0, 0] / s.level[0, 0])
        inv = np.linalg.inv(s.level[1:, 1:])
        first = s.step[1:, 1:] @ inv
        p = 2.0 * (s.n - 1) - np.trace(first)
        q = 2.0 * (3 * s.n - 4) - 2 * np.trace(s.bend[1:, 1:] @ inv) + np.trace(first @ first)
        mean = p / (s.n - k)
        var = 2.0 / ((s.n - k) * (s.n - k + 2)) * (q - p * mean)
        p_value = dist.normal_cdf((stat - mean) / math.sqrt(var))
        return {"statistic": stat, "p_value": p_value, "mean": float(mean), "variance": float(var)}
    e = F.col("residual")
    lagged = rows.with_columns({"__d": e - rows.row_lag("residual")}).df
    row = lagged.agg(F.sum(F.col("__d") * F.col("__d")), F.sum(e * e)).first()
    stat = float((row[0] or 0.0) / row[1])
    spectrum = within_spectrum(rows, regressors)
    n = float(spectrum.counts.sum())
    # The ratio does not depend on the size of the residuals, so its mean is that of the two forms.
    return {"statistic": stat, "p_value": ratio_tail(spectrum, stat), "mean": spectrum.mean(0.0) / (n - k)}
