"""Panel diagnostics: serial correlation and unit roots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import distributions as dist, missing
from ..operators.panel import Panel
from ..session import materialise, ship_package
from .moments import group, pairs
from .panel_models import RandomFit, random_effects

# Response surface of MacKinnon (1994) for the unit-root t statistic with intercept.
# Normal quantile of the p-value as a polynomial in the statistic; one set below and one above the
# switch point. The surface ends at a minimum and a maximum.
ADF_SWITCH, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_LOWER = (2.1659, 1.4412, 0.038269)
ADF_UPPER = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(stat: float) -> float:
    """p-value by the surface; 1 above its maximum, below its minimum the value it ends with (about 2e-30)."""
    if stat > ADF_MAX:
        return 1.0
    stat = max(stat, ADF_MIN)
    surface = ADF_LOWER if stat <= ADF_SWITCH else ADF_UPPER
    return dist.normal_cdf(sum(c * stat**i for i, c in enumerate(surface)))


def _boundary_squares(rows: Panel) -> float:
    """Sum of squared steps from the last residual of each entity to the first of the next one.

    Entities are range-partitioned and sorted; every task adds up its own steps and reports its
    first and last value, so that only the steps between tasks are left for the driver.
    """
    entity = rows.entity
    ship_package(rows.df.sparkSession)
    ends = rows.df.groupBy(*entity).agg(
        F.min_by("residual", rows.time).alias("head"), F.max_by("residual", rows.time).alias("tail")
    )
    ordered = ends.repartitionByRange(*entity).sortWithinPartitions(*entity)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        first, last, total = None, None, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            head, tail = pdf["head"].to_numpy(), pdf["tail"].to_numpy()
            if first is None:
                first = pdf.iloc[:1].copy()
            else:
                total += float((head[0] - last) ** 2)
            total += float(((head[1:] - tail[:-1]) ** 2).sum())
            last = tail[-1]
        if first is not None:
            yield first.assign(tail=last, total=total)

    schema = T.StructType(ends.schema.fields + [T.StructField("total", T.DoubleType())])
    parts = ordered.mapInPandas(walk, schema).orderBy(*entity).collect()
    between = sum((b["head"] - a["tail"]) ** 2 for a, b in zip(parts, parts[1:]))
    return float(sum(p["total"] for p in parts) + between)


def durbin_watson(panel: Panel, y: str, x: Sequence[str], across_entities: bool = False) -> tuple[float, RandomFit]:
    """Durbin-Watson statistic of random-effects residuals.

    Differences are taken inside entities, or along the whole sorted frame with
    ``across_entities``, which also counts the step from one entity to the next.
    """
    re = random_effects(panel, y, x)
    rows = panel.on(re.transformed_residuals(panel))
    if across_entities:
        rows = rows.on(materialise(rows.df))
    e = F.col("residual")
    row = (
        rows.with_columns({"__d": rows.row_lag("residual")})
        .df.agg(F.sum(F.pow(e - F.col("__d"), F.lit(2.0))), F.sum(e * e))
        .first()
    )
    steps = (row[0] or 0.0) + (_boundary_squares(rows) if across_entities else 0.0)
    return float(steps / row[1]), re


def adf_by_entity(panel: Panel, c: str, pmax: int = 4) -> DataFrame:
    """Augmented Dickey-Fuller regression with intercept per entity, lag order by Schwarz criterion.

    Moments for every lag order come from one grouped aggregate after one window; the small
    regressions are then solved in batches over entity rows. Entities too short for any order give
    no row; ``unit_root_fisher`` counts them.
    """
    ship_package(panel.df.sparkSession)
    base = panel.on(missing.finite_cases(panel.df.select(*panel.entity, panel.time, F.col(c).cast("double").alias("v")), ["v"]))
    # Levels relative to the first observation keep the sums of products well conditioned.
    origin = F.first("v").over(base.window)
    p1 = base.on(base.df.withColumns({"y1": base.row_lag("v") - origin, "dy": base.diff("v")}))
    rows = p1.df.withColumns({f"d{k}": p1.row_lag("dy", k) for k in range(1, pmax + 1)})
    aggs = []
    for order in range(pmax + 1):
        cols = ["dy", "y1", *[f"d{k}" for k in range(1, order + 1)]]
        # The longest lag is known exactly where all terms of this order are.
        ok = f"{cols[-1] if order else 'dy'} IS NOT NULL"
        aggs.append(f"count_if({ok}) AS n{order}")
        aggs += [f"sum(CASE WHEN {ok} THEN {c} END) AS t{order}_{i}" for i, c in enumerate(cols)]
        aggs += [f"sum(CASE WHEN {ok} THEN {cols[i]} * {cols[j]} END) AS s{order}_{i}_{j}" for i, j in pairs(len(cols))]
    table = group(rows, panel.entity, aggs)
    keys = table.select(*panel.entity).schema.fields
    schema = T.StructType(
        keys
        + [
            T.StructField("lags", T.IntegerType()),
            T.StructField("nobs", T.LongType()),
            T.StructField("adf", T.DoubleType()),
            T.StructField("p_value", T.DoubleType()),
        ]
    )
    entity = list(panel.entity)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            size = len(pdf)
            best = np.full(size, np.inf)
            stat, lags, nobs = np.full(size, np.nan), np.zeros(size, int), np.zeros(size, int)
            for order in range(pmax + 1):
                k = order + 1
                n = pdf[f"n{order}"].to_numpy()
                at = np.flatnonzero(n > k + 1)
                if not len(at):
                    continue
                s = np.zeros((len(at), k + 1, k + 1))
                sums = [pdf[f"t{order}_{i}"].to_numpy(dtype=float)[at] for i in range(k + 1)]
                for i, j in pairs(k + 1):
                    raw = pdf[f"s{order}_{i}_{j}"].to_numpy(dtype=float)[at]
                    s[:, i, j] = s[:, j, i] = raw - sums[i] * sums[j] / n[at]
                sxx, sxy = s[:, 1:, 1:], s[:, 1:, 0]
                d = np.sqrt(np.einsum("bii->bi", sxx))
                good = np.all(d > 0, axis=1)
                scaled = sxx[good] / (d[good][:, :, None] * d[good][:, None, :])
                solid = np.abs(np.linalg.det(scaled)) > 1e-10
                idx = np.flatnonzero(good)[solid]
                if not len(idx):
                    continue
                inv = np.linalg.inv(sxx[idx])
                b = np.einsum("bij,bj->bi", inv, sxy[idx])
                m = n[at[idx]]
                rss = s[idx, 0, 0] - np.einsum("bi,bi->b", b, sxy[idx])
                fit_ok = rss > 1e-12 * s[idx, 0, 0]
                idx, b, inv, m, rss = idx[fit_ok], b[fit_ok], inv[fit_ok], m[fit_ok], rss[fit_ok]
                sic = m * np.log(rss / m) + (k + 1) * np.log(m)
                t = b[:, 0] / np.sqrt(rss / (m - k - 1) * inv[:, 0, 0])
                rows_at = at[idx]
                wins = sic / m < best[rows_at]
                hit = rows_at[wins]
                best[hit], stat[hit], lags[hit], nobs[hit] = (sic / m)[wins], t[wins], order, m[wins]
            done = np.flatnonzero(np.isfinite(stat))
            out = pdf[entity].iloc[done].copy()
            out["lags"], out["nobs"], out["adf"] = lags[done], nobs[done], stat[done]
            out["p_value"] = [adf_p_value(v) for v in stat[done]]
            yield out

    return table.mapInPandas(solve, schema)


def unit_root_fisher(panel: Panel, c: str, pmax: int = 4) -> dict:
    """Maddala-Wu test: -2 sum ln p over entities is chi-square with two degrees each under a unit
    root in every entity. Also says how many statistics lie beyond the end of the surface, and how
    many entities have no identified regression and so take no part."""
    row = (
        adf_by_entity(panel, c, pmax)
        .agg(
            F.sum(-2.0 * F.ln("p_value")).alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("adf") < ADF_MIN).alias("beyond"),
        )
        .first()
    )
    stat, n = float(row["s"] or 0.0), int(row["n"])
    every = panel.df.select(*panel.entity).distinct().count()
    return {
        "statistic": stat, "df": 2 * n, "p_value": dist.chi2_upper(stat, 2 * n), "entities": n,
        "beyond_surface": int(row["beyond"]), "not_identified": every - n,
    }
