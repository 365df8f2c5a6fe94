"""Economic metrics as columns and composed table operators."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import codes, distributions as dist, missing
from ..session import ship_package
from . import aggregate, joins, reshape
from .panel import Panel

# Establishment size classes and the upper bound of each.
SIZE_CLASS_UPPER = {
    "n1_4": 4, "n5_9": 9, "n10_19": 19, "n20_49": 49, "n50_99": 99, "n100_249": 249,
    "n250_499": 499, "n500_999": 999, "n1000_1": 1499, "n1000_2": 2499, "n1000_3": 4999, "n1000_4": 5000,
}


def herfindahl_binned(total: str | Column, classes: Mapping[str, float] = SIZE_CLASS_UPPER) -> Column:
    """Concentration from class counts: sum of count times squared share of the class upper bound."""
    t = missing.col(total)
    terms = [F.col(c) * F.pow(missing.ratio(F.lit(float(u)), t), F.lit(2.0)) for c, u in classes.items()]
    return reduce(lambda a, b: a + b, terms)


def class_counts(value: str | Column, bounds: Mapping[str, tuple[float, float]]) -> list[Column]:
    """Aggregates that count rows per size class (closed intervals), to be used inside ``agg``."""
    v = missing.col(value)
    return [F.count(F.when(v.between(a, b), 1)).alias(n) for n, (a, b) in bounds.items()]


def labor_share(comp: str = "COMP", output: str = "GDP") -> Column:
    return missing.ratio(comp, output)


def payroll_share(comp: str = "COMP", output: str = "GDP", income: str = "PERSONAL_INC") -> Column:
    """Compensation over output net of proprietors' income."""
    return missing.ratio(F.col(comp), F.col(output) - (F.col(income) - F.col(comp)))


def per_unit(columns: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """Named ratios, e.g. establishments per worker, wage, productivity."""
    return {n: missing.ratio(a, b) for n, (a, b) in columns.items()}


def import_exposure(
    value_added: DataFrame,
    imports: DataFrame,
    crosswalk: DataFrame,
    employment: DataFrame,
    geo: str,
    sector: Column | None = None,
) -> DataFrame:
    """Employment-weighted import exposure by (geo, year, sector).

    Inputs: value_added(sector_no, year, value_added), imports(sector_no, year, import),
    crosswalk(sector_no, code), employment(geo, code, year, emp). Exposure of a code is absolute
    imports over value added; codes combine with employment shares inside the coarser sector.
    """
    exposure = (
        value_added.join(imports, ["sector_no", "year"])
        .join(crosswalk, "sector_no")
        .select("code", "year", missing.ratio(F.abs(F.col("import")), "value_added").alias("exposure"))
    )
    detailed = employment.join(exposure, ["code", "year"])
    coarse = codes.sector_of("code") if sector is None else sector
    return aggregate.weighted_mean(
        detailed.withColumn("sector", coarse), ["sector", "year", geo], "exposure", "emp", "import_exposure"
    )


def price_index(
    historical: DataFrame, current: DataFrame, code: str, years: Sequence[str], group: Column, group_name: str
) -> DataFrame:
    """Implicit price index: current-cost over historical-cost stock, averaged within the group."""
    both = joins.join_suffixed(historical, current, [code], ("_hist", "_current"))
    ratios = reshape.pairwise_ratio(both, [code], years, "_current", "_hist")
    long = reshape.to_long(ratios, [code], list(years), "year", "capital_cost_index")
    return (
        long.select(group.alias(group_name), F.col("year").cast("int").alias("year"), "capital_cost_index")
        .groupBy(group_name, "year")
        .agg(F.avg("capital_cost_index").alias("capital_cost_index"))
    )


def zone_roll_up(
    df: DataFrame,
    crosswalk: DataFrame,
    member: Mapping[str, str],
    by: Sequence[str],
    recoded: Mapping[str, Column],
    sums: Sequence[str],
    means: Sequence[str] = (),
) -> DataFrame:
    """Members to zones by a crosswalk, then the two-stage roll-up to coarser sectors."""
    return aggregate.two_stage_roll_up(joins.join_renamed(df, crosswalk, member), by, recoded, sums, means)


def vote_share(
    votes: DataFrame, by: Sequence[str], party: Column, candidate: str, total: str, name: str = "vote_share"
) -> DataFrame:
    """One party's votes over all votes, summed per zone and year."""
    summed = aggregate.sum_list(votes.filter(party), by, [candidate, total])
    return summed.withColumn(name, missing.ratio(candidate, total))


def censor(c: str | Column, low: float, high: float) -> Column:
    """NULL outside the limits."""
    v = missing.col(c)
    return F.when(v.between(low, high), v)


def change_map(
    members: DataFrame,
    panel: Panel,
    zone: Sequence[str],
    value: str,
    start: int,
    end: int,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Change of a zone value between two years, carried to each member for a choropleth."""
    change = panel.long_difference(start, end, levels={"delta": value})
    out = joins.to_members(members, change, zone)
    return out.withColumn("delta", censor("delta", *limits)) if limits else out


def linear_trend(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    x_limits: tuple[float, float] | None = None,
    y_limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Least-squares line through the points inside the axis limits, with what its band needs.

    The standard error of the line at x0 is ``sigma * sqrt(1/n + (x0 - x_mean)^2 / sxx)``.
    """
    kept = missing.finite_cases(df, [x, y])
    if x_limits:
        kept = kept.filter(F.col(x).between(*x_limits))
    if y_limits:
        kept = kept.filter(F.col(y).between(*y_limits))
    line = kept.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_avgx(y, x).alias("x_mean"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("__syy"),
        F.regr_sxy(y, x).alias("__sxy"),
        F.count(F.lit(1)).alias("n"),
    )
    rss = F.col("__syy") - F.col("slope") * F.col("__sxy")
    sigma = F.when(F.col("n") > 2, F.sqrt(missing.ratio(F.greatest(rss, F.lit(0.0)), F.col("n") - 2)))
    return line.withColumn("sigma", sigma).drop("__syy", "__sxy")


def trend_band(line: DataFrame, x_limits: tuple[float, float], points: int = 80, level: float = 0.95) -> DataFrame:
    """Fitted values of ``linear_trend`` lines on a grid, with the confidence band of the line.

    One row per line and grid point: the line's keys, ``x``, ``fit``, ``lower``, ``upper``. Lines of fewer than three
    points have no band.
    """
    ship_package(line.sparkSession)
    keys = [c for c in line.columns if c not in ("slope", "intercept", "r2", "x_mean", "sxx", "n", "sigma")]
    grid = np.linspace(x_limits[0], x_limits[1], points)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slope, intercept, n, mean, sxx, sigma = (pdf[c].to_numpy(float)[:, None] for c in ("slope", "intercept", "n", "x_mean", "sxx", "sigma"))
            fit = intercept + slope * grid
            quantile = {k: dist.t_quantile(0.5 + level / 2, k - 2) if k > 2 else np.nan for k in np.unique(n).tolist()}
            width = np.array([quantile[k] for k in n[:, 0].tolist()])[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                half = width * sigma * np.sqrt(1 / n + (grid - mean) ** 2 / sxx)
            out = pdf[keys].loc[pdf.index.repeat(points)].reset_index(drop=True)
            yield out.assign(x=np.tile(grid, len(pdf)), fit=fit.ravel(), lower=(fit - half).ravel(), upper=(fit + half).ravel())

    values = [T.StructField(n, T.DoubleType()) for n in ("x", "fit", "lower", "upper")]
    return line.mapInPandas(spread, T.StructType([*line.select(*keys).schema.fields, *values]))
