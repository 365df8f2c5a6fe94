"""Tables behind figures and maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import codes, missing
from ..operators import aggregate, metrics
from ..operators.panel import ROW, Panel
from .regional_panel import SECTOR, YEAR, ZONE


def change_table(df: DataFrame, start: int, end: int, sector: str | None = None, log_share: bool = False) -> DataFrame:
    """Changes between two years by (zone, sector), rows with infinite values removed.

    Growth from zero and logs of zero are infinite here, so such rows go. Employment shares are taken over all sectors before one sector is kept.
    """
    pair = df.filter(F.col(YEAR).isin(start, end)).withColumn("PSI", metrics.labor_share())
    pair = aggregate.share_of_total(pair.drop("EMPL_SHARE"), [ZONE, YEAR], {"EMPL_SHARE": "EMPL"}, bounded=True)
    if sector is not None:
        pair = pair.filter(F.col(SECTOR) == sector)
    levels = {"D_capital_cost_index": "capital_cost_index", "D_union_memb": "union_memb"}
    logs = {"D_HHI_LABOR": "HHI_labor", "D_unempl_rate": "unempl_rate"}
    growths = {"D_EMPL": "EMPL", "D_est": "est"}
    (logs if log_share else levels)["D_PSI"] = "PSI"
    (growths if log_share else levels)["D_EMPL_SHARE"] = "EMPL_SHARE"
    if "repub_share" in df.columns:
        levels["D_repub_share"] = "repub_share"
    out = Panel(pair, [ZONE, SECTOR], YEAR).long_difference(start, end, levels, logs, growths, infinite=True)
    return missing.drop_infinite(out)


def with_vote_share(
    df: DataFrame, votes: DataFrame, years: Mapping[int, int], party: str = "REPUBLICAN"
) -> DataFrame:
    """Attach one party's vote share, election years relabelled to panel years.

    votes: zone, year, party, candidatevotes, totalvotes.
    """
    share = metrics.vote_share(votes, [ZONE, YEAR], F.col("party") == party, "candidatevotes", "totalvotes", "repub_share")
    share = share.withColumn(YEAR, codes.recode(YEAR, dict(years)).cast("int"))
    return df.join(share.select(ZONE, YEAR, "repub_share"), [ZONE, YEAR], "left")


def median_series(df: DataFrame, sector: str, without: Sequence[int] = ()) -> DataFrame:
    """Medians over zones by sector and year."""
    kept = df.filter((F.col(SECTOR) == sector) & ~F.col(YEAR).isin(list(without)))
    return aggregate.median_bounded(kept, [SECTOR, YEAR], ["LABOR_SHARE", "HHI_labor", "EMPL_SHARE"])


def class_trend(split: DataFrame, start: int, end: int, x_limits, y_limits) -> DataFrame:
    """Trend of the payroll share change on the change of relative employment between classes.

    split: zone x year frame with COMP_prog, GDP_prog, EMPL_prog, EMPL_stag.
    """
    ratios = split.withColumns(
        {"PSI_prog": missing.ratio("COMP_prog", "GDP_prog"), "delta": missing.ratio("EMPL_prog", "EMPL_stag")}
    )
    change = Panel(ratios, [ZONE], YEAR).long_difference(start, end, {"Delta_delta": "delta", "Delta_psi": "PSI_prog"})
    return metrics.linear_trend(change, "Delta_delta", "Delta_psi", (), x_limits, y_limits)


def difference_export(df: DataFrame, time_index: Mapping[int, int], first: int, mode: str = ROW) -> DataFrame:
    """First differences of all years by (zone, sector) with a numeric time index, infinite rows
    removed; the first panel year drops out."""
    base = df.withColumn("PSI", metrics.labor_share())
    base = aggregate.share_of_total(base.drop("EMPL_SHARE"), [ZONE, YEAR], {"EMPL_SHARE": "EMPL"}, bounded=True)
    p = Panel(base, [ZONE, SECTOR], YEAR)
    cols = {
        "D_PSI": p.diff("PSI", mode),
        "D_EMPL": p.diff("EMPL", mode),
        "D_EMPL_SHARE": p.diff("EMPL_SHARE", mode),
        "D_HHI_LABOR": p.diff("HHI_labor", mode),
        "D_est": p.ratio_diff("est", "EMPL", mode, infinite=True),
        "D_capital_cost_index": p.log_diff("capital_cost_index", mode, infinite=True),
        "D_union_memb": p.diff("union_memb", mode),
    }
    out = p.with_columns(cols).df.filter(F.col(YEAR) != first).select(ZONE, SECTOR, *cols, YEAR)
    out = missing.drop_infinite(out)
    return out.withColumn("time", codes.recode(YEAR, dict(time_index), F.lit(1)).cast("int"))


def did_export(df: DataFrame, time_index: Mapping[int, int]) -> DataFrame:
    """Levels panel with a time index and establishments per worker; rows where that is infinite go, 0/0 stays as NaN."""
    out = df.withColumnRenamed("est", "firm_count")
    out = out.withColumn("firm_count_per_worker", missing.ratio_inf("firm_count", "EMPL"))
    out = missing.drop_infinite(out, ["firm_count_per_worker"])
    return out.withColumn("time", codes.recode(YEAR, dict(time_index), F.lit(1)).cast("int"))
