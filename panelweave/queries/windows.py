"""Shares, lags, differences."""

from pyspark.sql import functions as F

from ..operators import aggregate
from ..operators.panel import CALENDAR, Panel
from ..plans.regional_panel import YEAR
from ..plans.trade_panel import MEMBER, Tables, lines, member_panel
from .registry import MEMBERS, query, rounded

ROW_W = "(PARTITION BY cust ORDER BY year)"
CAL = "(PARTITION BY cust ORDER BY year RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"


def _panel(t: Tables) -> Panel:
    return Panel(member_panel(t), MEMBER, YEAR)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(sum(l_extendedprice) OVER (PARTITION BY l_suppkey), 0), 9) AS share
      FROM lineitem"""
)
def share_of_total(t: Tables):
    """Share of every line in its supplier's total; groups of any size."""
    out = aggregate.share_of_total(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_suppkey"], {"share": "l_extendedprice"}
    )
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "share"), 9)


@query(
    """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS pop,
        count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"""
)
def group_total(t: Tables):
    """Group totals kept on rows."""
    out = aggregate.attach_group(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], {"pop": F.sum("o_totalprice"), "n": F.count(F.lit(1))}
    )
    return rounded(out.select("o_orderkey", "pop", "n"), 2)


@query(
    f"""WITH {MEMBERS} SELECT cust, year, round(lag(empl) OVER {ROW_W}, 2) AS empl_1, round(lag(labor_share, 2) OVER {ROW_W}, 6) AS ls_2 FROM mp"""
)
def row_lag(t: Tables):
    """Previous observation, however long ago."""
    p = _panel(t)
    return rounded(p.df.select(MEMBER, YEAR, F.round(p.row_lag("EMPL"), 2).alias("empl_1"), p.row_lag("LABOR_SHARE", 2).alias("ls_2")))


@query(
    f"""WITH {MEMBERS} SELECT cust, year, {', '.join(f'round(first(labor_share) OVER {CAL.format(k=k)}, 6) AS ls_{k}' for k in (1, 2, 3))} FROM mp"""
)
def calendar_lag(t: Tables):
    """Value exactly k years earlier, NULL across a gap."""
    p = _panel(t)
    return rounded(p.df.select(MEMBER, YEAR, *[p.calendar_lag("LABOR_SHARE", k).alias(f"ls_{k}") for k in (1, 2, 3)]))


@query(
    f"""WITH {MEMBERS} SELECT cust, year, round(labor_share - lag(labor_share) OVER {ROW_W}, 6) AS d_row,
        round(labor_share - first(labor_share) OVER {CAL.format(k=1)}, 6) AS d_cal FROM mp"""
)
def first_diff(t: Tables):
    """First differences by row and by calendar."""
    p = _panel(t)
    return rounded(p.df.select(MEMBER, YEAR, p.diff("LABOR_SHARE").alias("d_row"), p.diff("LABOR_SHARE", CALENDAR).alias("d_cal")))


@query(
    f"""WITH {MEMBERS}, l AS (SELECT *, lag(unempl_rate) OVER {ROW_W} AS u1, lag(est) OVER {ROW_W} AS e1 FROM mp)
      SELECT cust, year, round(ln(est) - ln(e1), 6) AS d_est,
        CASE WHEN unempl_rate > 0 AND u1 > 0 THEN round(ln(unempl_rate) - ln(u1), 6) END AS d_tax FROM l"""
)
def log_diff(t: Tables):
    """Log differences, NULL where a level is not positive."""
    p = _panel(t)
    return rounded(p.df.select(MEMBER, YEAR, p.log_diff("est").alias("d_est"), p.log_diff("unempl_rate").alias("d_tax")))


@query(
    f"""WITH {MEMBERS}, l AS (SELECT *, lag(empl) OVER {ROW_W} AS e1, lag(unempl_rate) OVER {ROW_W} AS u1 FROM mp)
      SELECT cust, year, round((empl - e1) / e1, 6) AS g_empl, round((unempl_rate - u1) / nullif(u1, 0), 6) AS g_tax FROM l"""
)
def growth_rate(t: Tables):
    p = _panel(t)
    return rounded(p.df.select(MEMBER, YEAR, p.growth("EMPL").alias("g_empl"), p.growth("unempl_rate").alias("g_tax")))


@query(
    f"""WITH {MEMBERS} SELECT cust, year, round(est / empl - lag(est) OVER {ROW_W} / lag(empl) OVER {ROW_W}, 6) AS d_ratio FROM mp"""
)
def ratio_diff(t: Tables):
    """Change of a ratio of two columns."""
    p = _panel(t)
    return rounded(p.df.select(MEMBER, YEAR, p.ratio_diff("est", "EMPL").alias("d_ratio")))


@query(
    f"""WITH {MEMBERS}, e AS (SELECT * FROM mp WHERE year = 2000), s AS (SELECT * FROM mp WHERE year = 1996)
      SELECT e.cust, round(e.labor_share - s.labor_share, 6) AS d_ls, round(ln(e.hhi_labor) - ln(s.hhi_labor), 6) AS d_hhi,
        round((e.empl - s.empl) / s.empl, 6) AS g_empl FROM e LEFT JOIN s USING (cust)"""
)
def long_diff(t: Tables):
    """Change between two chosen years without sorting."""
    out = _panel(t).long_difference(1996, 2000, {"d_ls": "LABOR_SHARE"}, {"d_hhi": "HHI_labor"}, {"g_empl": "EMPL"})
    return rounded(out)


@query(
    f"""WITH {MEMBERS} SELECT cust, year, round(labor_share - avg(labor_share) OVER (PARTITION BY cust), 6) AS ls_w,
        round(hhi_labor - avg(hhi_labor) OVER (PARTITION BY cust), 6) AS hhi_w FROM mp"""
)
def within_demean(t: Tables):
    """Deviations from entity means."""
    out = _panel(t).demean(["LABOR_SHARE", "HHI_labor"])
    return rounded(out.select(MEMBER, YEAR, F.col("LABOR_SHARE_w").alias("ls_w"), F.col("HHI_labor_w").alias("hhi_w")))
