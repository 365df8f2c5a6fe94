"""Gaussian mixtures with constrained covariances: size, shape and number of classes chosen by BIC.

The covariance of a class is its volume times its shape along fixed or free axes. E, V and I say whether volume, shape and
axes are equal for all classes, vary, or are the coordinate axes:

* EII, VII: spheres of one size, or of a size for each class;
* EEI, VVI: one axis-parallel ellipsoid for all, or one for each;
* EEE, VVV: one free ellipsoid for all, or one for each.

Every model (number of classes, family) takes part in the same pass of each round: tasks add up expected counts, sums
and products of all models over Arrow batches, and only those sums come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import missing
from ..session import materialise, ship_package
from .gmm_blocks import emitted, summed
from .mixture import MIN_VARIANCE, _log_density

FAMILIES = ("EII", "VII", "EEI", "VVI", "EEE", "VVV")


def covariances(family: str, size: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """The covariances of a family that maximise the likelihood, from class sizes and scatter matrices."""
    k, d, _ = scatter.shape
    if family[0] == "E":
        scatter, size = np.repeat(scatter.sum(axis=0)[None], k, axis=0), np.full(k, size.sum())
    own = scatter / np.maximum(size, 1e-9)[:, None, None]
    if family.endswith("II"):
        own = np.einsum("kii->k", own)[:, None, None] / d * np.eye(d)
    elif family.endswith("I"):
        own = own * np.eye(d)
    values, axes = np.linalg.eigh(own)
    return np.einsum("kij,kj,klj->kil", axes, np.maximum(values, MIN_VARIANCE), axes)


def parameters(family: str, k: int, d: int) -> int:
    """Free parameters: weights, means and those of the covariances."""
    one = {"EII": 1, "VII": k, "EEI": d, "VVI": k * d, "EEE": d * (d + 1) // 2, "VVV": k * d * (d + 1) // 2}[family]
    return k - 1 + k * d + one


@dataclass
class Model:
    k: int
    family: str
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    likelihood: float = -math.inf
    open: bool = True

    @classmethod
    def start(cls, k: int, d: int, family: str) -> Model:
        """Classes spaced along all standardised features, so that the result depends on the rows alone."""
        spread = np.array([(2 * c + 1) / k - 1 for c in range(k)])
        return cls(k, family, np.full(k, 1 / k), np.outer(spread, np.full(d, 1.5)), np.repeat(np.eye(d)[None], k, axis=0))

    def bic(self, n: int) -> float:
        return -2.0 * self.likelihood + parameters(self.family, self.k, self.means.shape[1]) * math.log(n)

    def expected(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood, class sizes, sums and products of the rows under this model, in one row of numbers."""
        logs = np.empty((len(x), self.k))
        d = x.shape[1]
        for c in range(self.k):
            root = np.linalg.inv(np.linalg.cholesky(self.covs[c]))
            z = (x - self.means[c]) @ root.T
            logs[:, c] = math.log(self.weights[c]) - 0.5 * d * math.log(2 * math.pi) + np.log(np.diag(root)).sum() - 0.5 * (z * z).sum(axis=1)
        top = logs.max(axis=1)
        total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
        r = np.exp(logs - total[:, None])
        products = np.einsum("nk,ni,nj->kij", r, x, x)
        return np.concatenate([[total.sum()], r.sum(axis=0), (r.T @ x).ravel(), products.ravel()])

    def maximise(self, sums: np.ndarray, n: int) -> None:
        k, d = self.means.shape
        size, first, second = sums[1 : 1 + k], sums[1 + k : 1 + k + k * d].reshape(k, d), sums[1 + k + k * d :].reshape(k, d, d)
        self.weights = np.maximum(size / n, 1e-12)
        self.means = first / np.maximum(size, 1e-9)[:, None]
        scatter = second - size[:, None, None] * self.means[:, :, None] * self.means[:, None, :]
        self.covs = covariances(self.family, size, scatter)

    def densities(self, names: Sequence[str]) -> list[str]:
        """Log densities of the classes in SQL, in order of their means."""
        order = sorted(range(self.k), key=lambda c: tuple(self.means[c]))
        return [_log_density(names, self.weights[c], self.means[c], self.covs[c]) for c in order]


def fit_families(frame: DataFrame, names: Sequence[str], n: int, classes: Iterable[int], families: Sequence[str], tol: float, max_iter: int) -> list[Model]:
    """All models by expectation-maximisation, one job per round for those still open.

    A model closes when a round adds at most ``tol`` to its mean log likelihood, or after ``max_iter`` rounds.
    """
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {', '.join(sorted(unknown))}")
    ship_package(frame.sparkSession)
    models = [Model.start(k, len(names), f) for k in classes for f in families]
    rows = frame.select(*names)
    for round_ in range(max_iter + 1):
        going = {i: m for i, m in enumerate(models) if m.open}
        if not going:
            break

        def run(batches: Iterator[pa.RecordBatch], going: dict[int, Model] = going) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                if b.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                    for i, m in going.items():
                        own = m.expected(x)
                        total[i, 0] = total[i, 0] + own if (i, 0) in total else own
            yield emitted(total)

        for (i, _), sums in summed(rows, run).items():
            m = models[i]
            gain, m.likelihood = sums[0] - m.likelihood, float(sums[0])
            m.open = gain > tol * n and round_ < max_iter
            if m.open:
                m.maximise(sums, n)
    return models


def mixture_families(
    df: DataFrame,
    features: Sequence[str],
    classes: Iterable[int] = (1, 2, 3),
    families: Sequence[str] = FAMILIES,
    tol: float = 1e-5,
    max_iter: int = 200,
) -> tuple[DataFrame, list[Model]]:
    """Most likely class per row under the model with the lowest BIC, and all models fitted.

    Features are standardised first; rows that lack one take no part. Of equal BIC the first model counts, in
    the order of classes, then families. Without rows there are no models.
    """
    kept = materialise(missing.finite_cases(df, features))
    stats = kept.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(features)]
    ).first()
    n = stats["n"]
    if not n:
        return kept.withColumn("class", F.lit(0)), []
    names = [f"__z_{i}" for i in range(len(features))]
    frame = kept.withColumns({z: (F.col(c) - F.lit(stats[f"m_{i}"])) / F.lit(stats[f"s_{i}"] or 1.0) for i, (z, c) in enumerate(zip(names, features))})
    models = fit_families(frame, names, n, classes, families, tol, max_iter)
    best = min(models, key=lambda m: m.bic(n))
    label: Column = F.lit(0)
    if best.k > 1:
        densities = F.array(*[F.expr(p) for p in best.densities(names)])
        label = (F.array_position(densities, F.array_max(densities)) - 1).cast("int")
    return frame.withColumn("class", label).drop(*names), models
