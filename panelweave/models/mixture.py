"""Classification by a Gaussian mixture, number of classes by BIC."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import missing
from ..session import materialise
from .moments import number, pairs

#: Least variance of a standardised feature inside a class, so that no class shrinks to a point.
MIN_VARIANCE = 1e-6


def _log_density(names: Sequence[str], weight: float, mean: np.ndarray, cov: np.ndarray) -> str:
    """ln(weight * normal density) as SQL over the feature columns."""
    root = np.linalg.inv(np.linalg.cholesky(cov))
    const = math.log(weight) - 0.5 * len(names) * math.log(2 * math.pi) + float(np.log(np.diag(root)).sum())
    squares = []
    for r in range(len(names)):
        term = " + ".join(f"{number(root[r, c])} * (`{names[c]}` - {number(mean[c])})" for c in range(r + 1))
        squares.append(f"({term}) * ({term})")
    return f"{number(const)} - 0.5D * ({' + '.join(squares)})"


def _fit(frame: DataFrame, names: Sequence[str], k: int, n: int, tol: float, max_iter: int) -> tuple[float, list[str]]:
    """Log likelihood and the log densities of the classes, in order of their means.

    Expectation-maximisation as one aggregate per round. It starts from classes spaced along all
    features, so the result depends on the rows alone, and ends when the likelihood settles.
    """
    d = len(names)
    spread = [(2 * c + 1) / k - 1 for c in range(k)]
    weights, means, covs = np.full(k, 1 / k), np.outer(spread, np.full(d, 1.5)), np.array([np.eye(d)] * k)
    before = -math.inf
    for _ in range(max_iter):
        parts = [_log_density(names, w, m, v) for w, m, v in zip(weights, means, covs)]
        scored = frame.selectExpr(*[f"`{c}`" for c in names], *[f"{p} AS l_{c}" for c, p in enumerate(parts)])
        top = f"greatest({', '.join(f'l_{c}' for c in range(k))})" if k > 1 else "l_0"
        scored = scored.selectExpr("*", f"{top} AS top")
        scored = scored.selectExpr("*", f"top + ln({' + '.join(f'exp(l_{c} - top)' for c in range(k))}) AS total")
        aggs = ["sum(total) AS total"]
        for c in range(k):
            r = f"exp(l_{c} - total)"
            aggs += [f"sum({r}) AS n_{c}"] + [f"sum({r} * `{x}`) AS m_{c}_{i}" for i, x in enumerate(names)]
            aggs += [f"sum({r} * `{names[i]}` * `{names[j]}`) AS s_{c}_{i}_{j}" for i, j in pairs(d)]
        row = scored.selectExpr(*aggs).first().asDict()
        if row["total"] - before <= tol * n:
            break
        before = row["total"]
        for c in range(k):
            size = max(row[f"n_{c}"], 1e-9)
            weights[c] = max(row[f"n_{c}"] / n, 1e-12)
            means[c] = [row[f"m_{c}_{i}"] / size for i in range(d)]
            for i, j in pairs(d):
                covs[c, i, j] = covs[c, j, i] = row[f"s_{c}_{i}_{j}"] / size - means[c, i] * means[c, j]
            values, axes = np.linalg.eigh(covs[c])
            covs[c] = (axes * np.maximum(values, MIN_VARIANCE)) @ axes.T
    order = sorted(range(k), key=lambda c: tuple(means[c]))
    return before, [_log_density(names, weights[c], means[c], covs[c]) for c in order]


def mixture_classes(
    df: DataFrame, features: Sequence[str], classes: Iterable[int] = (1, 2, 3), tol: float = 1e-5, max_iter: int = 200
) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Most likely class per row under the mixture with the lowest BIC, and the BIC of each size.

    Features are standardised first; the input is computed once. Fitting ends when a round adds less
    than ``tol`` to the mean log likelihood. Classes are numbered by their means, so the result does
    not depend on how rows are dealt out.
    """
    kept = materialise(missing.finite_cases(df, features))
    stats = kept.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in features],
    ).first()
    names = [f"__z_{c}" for c in features]
    if not stats["n"]:
        return kept.withColumn("class", F.lit(0)), []
    z = {f"__z_{c}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in features}
    frame, n, d = kept.withColumns(z), stats["n"], len(features)
    best, scores = None, []
    for k in classes:
        likelihood, parts = _fit(frame, names, k, n, tol, max_iter)
        bic = -2.0 * likelihood + ((k - 1) + k * (d + d * (d + 1) / 2)) * math.log(n)
        scores.append((k, bic))
        if best is None or bic < best[0]:
            best = (bic, parts)
    label: Column = F.lit(0)
    if len(best[1]) > 1:
        densities = F.array(*[F.expr(p) for p in best[1]])
        label = (F.array_position(densities, F.array_max(densities)) - 1).cast("int")
    return frame.withColumn("class", label).drop(*names), scores
