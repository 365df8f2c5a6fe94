"""Estimation samples: filter, derived columns, panel key.

Sector codes, excluded years and the lag mode are parameters; the defaults are those of the study.
Every function takes the zone panel and returns a frame ready for a fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import missing
from ..models import linear
from ..operators import aggregate
from ..operators.panel import ROW, Panel
from ..operators.metrics import payroll_share
from .regional_panel import SECTOR, YEAR, ZONE

MANUFACTURING = "31-33"
FD_CONTROLS = ["D_HHI_labor", "D_union_memb", "D_capital_cost_index", "D_unempl_rate"]


def positive(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) > 0 for c in columns])


def _sector_years(df: DataFrame, sector: str | None, without: Sequence[int]) -> DataFrame:
    out = df.filter(~F.col(YEAR).isin(list(without))) if without else df
    return out if sector is None else out.filter(F.col(SECTOR) == sector)


def skipped_sector() -> Column:
    """Sectors the per-industry regressions leave out."""
    return F.col(SECTOR).startswith("2") | F.col(SECTOR).isin("53", "55")


def industry_differences(df: DataFrame, without: Sequence[int] = (2001,), mode: str = ROW) -> DataFrame:
    """Differences and log differences by (zone, sector), of those measures the panel has."""
    kept = _sector_years(df, None, without).filter(positive("EMPL", "est", "LABOR_SHARE", "PAYROLL_SHARE", "HHI_labor"))
    p = Panel(kept, [ZONE, SECTOR], YEAR)
    level = ["LABOR_SHARE", "PAYROLL_SHARE", "est_per_worker", "HHI_labor", "capital_cost_index"]
    logs = ["est", "union_memb", "unempl_rate"]
    cols = {f"D_{c}": p.diff(c, mode) for c in level if c in df.columns}
    return p.with_columns(cols | {f"D_{c}": p.log_diff(c, mode) for c in logs if c in df.columns}).df


def industry_coefficients(
    df: DataFrame, x: Sequence[str] = FD_CONTROLS, without: Sequence[int] = (2001,), mode: str = ROW
) -> DataFrame:
    """First-difference regression of the labour share for every sector, robust, in one job."""
    diffs = industry_differences(df, without, mode).filter(~skipped_sector())
    out = linear.grouped_ols(diffs, [SECTOR], "D_LABOR_SHARE", x)
    return out.withColumnRenamed(SECTOR, "Industry")


def _population(df: DataFrame) -> DataFrame:
    return aggregate.attach_group_window(df, [ZONE, YEAR], {"POP": F.sum("EMPL")})


def sector_differences(df: DataFrame, sector: str = "42-45", land: str | None = None, mode: str = ROW) -> DataFrame:
    """One sector: log change of the payroll share and level changes by zone."""
    base = _population(df)
    base = aggregate.share_of_total(base.drop("EMPL_SHARE"), [ZONE, YEAR], {"EMPL_SHARE": "EMPL"}, bounded=True)
    base = base.withColumns(
        {"PSI": payroll_share(), "wage": missing.ratio("COMP", "EMPL"), "productivity": missing.ratio("GDP", "EMPL")}
    )
    p = Panel(_sector_years(base, sector, ()).filter(positive("EMPL", "est", "PSI", "HHI_labor")), [ZONE], YEAR)
    cols = {f"D_{c}": p.diff(c, mode) for c in ["EMPL_SHARE", "est", "HHI_labor"]}
    cols["D_PSI"] = p.log_diff("PSI", mode)
    cols["D_est_per_worker"] = p.ratio_diff("est", "EMPL", mode)
    cols["D_est_per_capita"] = p.ratio_diff("est", "POP", mode)
    if land:
        cols["D_est_per_mile"] = p.ratio_diff("est", land, mode)
    return p.with_columns(cols).df


def two_way_sample(df: DataFrame, sector: str = MANUFACTURING, land: str | None = None) -> DataFrame:
    """Payroll share and establishments per capita (and per area) of one sector."""
    base = _population(df).withColumns({"PSI": payroll_share(), "est_per_capita": missing.ratio("est", "POP")})
    if land:
        base = base.withColumn("est_per_mile", missing.ratio("est", land))
    return _sector_years(base, sector, ()).filter(positive("est"))


def iv_sample(
    df: DataFrame, sector: str = MANUFACTURING, without: Sequence[int] = (2001,), mode: str = ROW
) -> DataFrame:
    """Differences by (zone, sector) and their calendar lags for the lagged 2SLS equation."""
    kept = _sector_years(df, sector, without).filter(
        positive("EMPL", "est", "LABOR_SHARE", "PAYROLL_SHARE", "HHI_labor")
    )
    p = Panel(kept, [ZONE, SECTOR], YEAR)
    cols = {f"D_{c}": p.diff(c, mode) for c in ["LABOR_SHARE", "PAYROLL_SHARE", "EMPL_SHARE", "union_memb", "capital_cost_index"]}
    cols |= {f"D_{c}": p.log_diff(c, mode) for c in ["est", "HHI_labor", "unempl_rate"]}
    q = p.with_columns(cols)
    lagged = ["LABOR_SHARE", "D_HHI_labor", "D_union_memb", "D_capital_cost_index", "D_unempl_rate", "D_EMPL_SHARE"]
    return q.with_columns({f"L_{c}": q.calendar_lag(c) for c in lagged}).df


def gmm_sample(df: DataFrame, sector: str = MANUFACTURING, without: Sequence[int] = (2001, 2014)) -> DataFrame:
    return _sector_years(df, sector, without)


SINGLE_EQUATION = [
    YEAR, ZONE, "LABOR_SHARE", "unempl_rate", "HHI_labor", "capital_cost_index", "union_memb", "EMPL_SHARE",
]


def single_equation_sample(
    df: DataFrame, sector: str = MANUFACTURING, without: Sequence[int] = (2001, 2014)
) -> DataFrame:
    kept = _sector_years(df, sector, without).filter((F.col("HHI_labor") > 0) & (F.col("LABOR_SHARE") < 1))
    return kept.select(*SINGLE_EQUATION)


def multi_equation_sample(df: DataFrame, sector: str = MANUFACTURING, without: Sequence[int] = (2001,)) -> DataFrame:
    return _sector_years(df, sector, without).select(*SINGLE_EQUATION, "import_exposure")
