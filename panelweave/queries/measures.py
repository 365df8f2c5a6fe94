"""Economic metrics, roll-ups, figure tables, estimation samples."""

from pyspark.sql import functions as F

from ..functions import codes, missing
from ..models.mixture import mixture_classes as classify
from ..operators import aggregate, metrics, reshape
from ..operators.panel import Panel
from ..plans import figures, samples
from ..plans.regional_panel import SECTOR, YEAR, ZONE
from ..plans.trade_panel import (
    CLASS_UPPER, MEANS, MEMBER, QUANTITY_CLASSES, SUMS, SUPER_SEGMENT, Tables, lines, member_panel, members, trade_zone_panel,
)
from ..session import materialise
from .registry import LINES, MEMBERS, query, rounded, zones_sql
from .shape import _SPLIT_SQL, _STOCK_GRID, _stocks

KEYS = "zone AS CZ_ID, sector AS IndustryClassification, year"
S = "FURNITURE"


#: Added before rounding ratios of short decimals, so that exact halves fall the same way in any engine.
NUDGE = 1e-9


@query(f"WITH {MEMBERS} SELECT cust, year, round(hhi_labor, 6) AS hhi FROM mp")
def hhi_binned(t: Tables):
    """Concentration from raw lines: counted into size classes, then the class upper bounds."""
    binned = lines(t).groupBy(MEMBER, YEAR).agg(
        F.sum("l_quantity").alias("EMPL"), *metrics.class_counts("l_quantity", QUANTITY_CLASSES)
    )
    return rounded(binned.select(MEMBER, YEAR, metrics.herfindahl_binned("EMPL", CLASS_UPPER).alias("hhi")))


@query(f"WITH {zones_sql()} SELECT {KEYS}, round(labor_share, 6) AS ls, round(payroll_share, 6) AS ps FROM zp")
def labor_shares(t: Tables):
    return rounded(trade_zone_panel(t).select(ZONE, SECTOR, YEAR, F.col("LABOR_SHARE").alias("ls"), F.col("PAYROLL_SHARE").alias("ps")))


@query(
    f"""WITH {MEMBERS} SELECT cust, year, round(est / empl + {NUDGE}, 6) AS est_per_worker, round(comp / empl + {NUDGE}, 6) AS wage,
      round(gdp / empl + {NUDGE}, 6) AS productivity FROM mp"""
)
def per_unit_ratios(t: Tables):
    """Establishments per worker, wage and productivity."""
    p = member_panel(t).drop("est_per_worker")
    cols = metrics.per_unit({"est_per_worker": ("est", "EMPL"), "wage": ("COMP", "EMPL"), "productivity": ("GDP", "EMPL")})
    return rounded(p.select(MEMBER, YEAR, *[(c + F.lit(NUDGE)).alias(n) for n, c in cols.items()]))


@query(f"WITH {zones_sql()} SELECT {KEYS}, round(empl_share, 6) AS es, round(va_share, 6) AS vs FROM zp")
def industry_shares(t: Tables):
    return rounded(trade_zone_panel(t).select(ZONE, SECTOR, YEAR, F.col("EMPL_SHARE").alias("es"), F.col("VA_SHARE").alias("vs")))


@query(
    """WITH l AS (SELECT *, year(l_shipdate) AS y, CAST(substr(p_brand, 7) AS INTEGER) AS sec
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
      x AS (SELECT sec, y, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE 0 END) AS imp, sum(l_extendedprice) AS va FROM l GROUP BY 1, 2),
      e AS (SELECT s_nationkey, sec, y, sum(l_quantity) AS emp FROM l GROUP BY 1, 2, 3)
      SELECT CASE WHEN sec <= 9 THEN 'low' WHEN sec <= 19 THEN 'mid' ELSE 'high' END AS sector, CAST(y AS INTEGER) AS year, s_nationkey AS nation,
        round(sum(emp * abs(imp) / va) / sum(emp), 6) AS import_exposure
      FROM e JOIN x USING (sec, y) GROUP BY 1, 2, 3"""
)
def import_exposure(t: Tables):
    """Returned value over total value by detailed code, combined with quantity weights per nation."""
    code = F.substring("p_brand", 7, 9).cast("int")
    brand = t.part.select(F.col("p_partkey").alias("l_partkey"), code.alias("code"))
    nation = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    returned = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(0.0)
    cells = t.lineitem.join(brand, "l_partkey").groupBy("code", "l_suppkey", F.year("l_shipdate").cast("int").alias("year")).agg(
        F.sum("l_extendedprice").alias("va"), F.sum(returned).alias("import"), F.sum("l_quantity").alias("emp")
    )
    by_nation = cells.join(nation, "l_suppkey").groupBy("nation", "code", "year").agg(
        F.sum("va").alias("va"), F.sum("import").alias("import"), F.sum("emp").alias("emp")
    )
    by_nation = materialise(by_nation)  # nations x codes x years; read three times below
    national = by_nation.groupBy(F.col("code").alias("sector_no"), "year").agg(
        F.sum("va").alias("value_added"), F.sum("import").alias("import")
    )
    walk = t.part.select(code.alias("code")).distinct().withColumn("sector_no", F.col("code"))
    employment = by_nation.select("nation", "code", "year", "emp")
    coarse = F.when(F.col("code") <= 9, "low").when(F.col("code") <= 19, "mid").otherwise("high")
    out = metrics.import_exposure(
        national.select("sector_no", "year", "value_added"), national.select("sector_no", "year", "import"), walk, employment, "nation", coarse
    )
    return rounded(out)


@query(
    f"""WITH {_STOCK_GRID} SELECT CASE WHEN p_type IN ('LARGE','MEDIUM','SMALL') THEN 'SIZED' ELSE p_type END AS grp, year,
      round(avg(price_index), 6) AS capital_cost_index FROM cells GROUP BY 1, 2"""
)
def capital_cost_index(t: Tables):
    """Implicit price index from two wide stock tables, averaged in groups."""
    hist, curr, years = _stocks(t)
    group = codes.recode("p_type", {"LARGE": "SIZED", "MEDIUM": "SIZED", "SMALL": "SIZED"})
    return rounded(metrics.price_index(hist, curr, "p_type", years, group, "grp"))


@query(
    f"""WITH {zones_sql(merged=True)} SELECT {KEYS}, round(gdp, 2) AS gdp, round(comp, 4) AS comp, empl, est,
      round(union_memb, 9) AS union_memb, round(hhi_labor, 6) AS hhi FROM zp"""
)
def zone_rollup(t: Tables):
    """Members to zones, then segments to super-segments, with means of means."""
    p = trade_zone_panel(t, merged=True)
    out = p.select(
        ZONE, SECTOR, YEAR, F.col("GDP").alias("gdp"), F.col("COMP").alias("comp"), F.col("EMPL").alias("empl"),
        F.col("est").cast("double").alias("est"), "union_memb", F.col("HHI_labor").alias("hhi"),
    )
    return rounded(out, 6, gdp=2, comp=4, union_memb=9)


_VOTES = f"""{LINES}, votes AS (SELECT c_nationkey AS zone, year, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS candidate,
  round(sum(l_extendedprice), 2) AS total FROM lines JOIN customer ON cust = c_custkey GROUP BY 1, 2)"""


def _votes(t: Tables):
    by_member = lines(t).groupBy(MEMBER, YEAR, "l_returnflag").agg(F.sum("l_extendedprice").alias("candidatevotes"))
    by_zone = by_member.join(members(t), MEMBER).groupBy(ZONE, YEAR, F.col("l_returnflag").alias("party")).agg(
        F.sum("candidatevotes").alias("candidatevotes")
    )
    return aggregate.attach_group_window(by_zone, [ZONE, YEAR], {"totalvotes": F.sum("candidatevotes")})


@query(f"WITH {_VOTES} SELECT zone AS CZ_ID, year, candidate AS candidatevotes, total AS totalvotes, round(candidate / total, 6) AS share FROM votes")
def vote_share(t: Tables):
    """Share of returned value by zone and year."""
    out = metrics.vote_share(_votes(t), [ZONE, YEAR], F.col("party") == "R", "candidatevotes", "totalvotes", "share")
    return rounded(out, 6, candidatevotes=2, totalvotes=2)


@query(
    f"""WITH {_VOTES}, {zones_sql().replace(LINES + ', ', '')}
      SELECT zp.zone AS CZ_ID, sector AS IndustryClassification, zp.year, round(candidate / total, 6) AS repub_share
      FROM zp LEFT JOIN (SELECT *, CASE year WHEN 1995 THEN 1996 WHEN 2001 THEN 2000 ELSE year END AS py FROM votes WHERE year IN (1995, 1998, 2001)) v
        ON v.zone = zp.zone AND v.py = zp.year"""
)
def vote_panel(t: Tables):
    """Vote shares of relabelled election years on the zone panel."""
    elections = _votes(t).filter(F.col(YEAR).isin(1995, 1998, 2001))
    out = figures.with_vote_share(trade_zone_panel(t), elections, {1995: 1996, 2001: 2000}, party="R")
    return rounded(out.select(ZONE, SECTOR, YEAR, "repub_share"))


@query(
    f"""WITH {zones_sql()}, d AS (SELECT e.zone, e.sector, e.hhi_labor - s.hhi_labor AS delta FROM zp e
        LEFT JOIN zp s ON s.zone = e.zone AND s.sector = e.sector AND s.year = 1996 WHERE e.year = 2000)
      SELECT c_custkey AS cust, zone AS CZ_ID, sector AS IndustryClassification,
        CASE WHEN delta BETWEEN -0.05 AND 0.05 THEN round(delta, 6) END AS delta
      FROM customer JOIN d ON zone = c_nationkey AND sector = c_mktsegment"""
)
def choropleth_table(t: Tables):
    """Change of zone concentration between two years on every member, censored to colour limits."""
    zones = Panel(trade_zone_panel(t), [ZONE, SECTOR], YEAR)
    return rounded(metrics.change_map(members(t), zones, [ZONE, SECTOR], "HHI_labor", 1996, 2000, (-0.05, 0.05)))


@query(
    f"""WITH s AS ({_SPLIT_SQL}),
      d AS (SELECT e.CZ_ID, e.EMPL_prog / e.EMPL_stag - s.EMPL_prog / s.EMPL_stag AS x, e.GDP_prog / e.EMPL_prog - s.GDP_prog / s.EMPL_prog AS y
        FROM s e JOIN s ON s.CZ_ID = e.CZ_ID AND s.year = 1995 WHERE e.year = 2000),
      k AS (SELECT * FROM d WHERE x BETWEEN -0.4 AND 0.4 AND y BETWEEN -200 AND 200)
      SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2,
        round(avg(x), 6) AS x_mean, round(regr_sxx(y, x), 6) AS sxx, count(*) AS n,
        round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)), 4) AS sigma FROM k"""
)
def censored_trend(t: Tables):
    """Line through long differences of class ratios, points outside the axis limits left out."""
    base = lines(t).groupBy(MEMBER, YEAR).agg(F.sum("l_extendedprice").alias("GDP"), F.sum("l_quantity").alias("EMPL"))
    klass = F.when(F.col(SECTOR).isin("AUTOMOBILE", "MACHINERY"), "prog").otherwise("stag")
    classed = base.join(members(t), MEMBER).withColumn("class", klass)
    split = reshape.split_by_class(classed, [ZONE, YEAR], "class", ["prog", "stag"], ["GDP", "EMPL"])
    split = split.withColumn("COMP_prog", F.col("GDP_prog")).withColumn("GDP_prog", F.col("EMPL_prog"))
    return rounded(figures.class_trend(split, 1995, 2000, (-0.4, 0.4), (-200, 200)), 4, r2=6, x_mean=6, sxx=6)


@query(
    f"""WITH {zones_sql()} SELECT sector AS IndustryClassification, year, round(median(labor_share), 6) AS LABOR_SHARE,
      round(median(hhi_labor), 6) AS HHI_labor, round(median(empl_share), 6) AS EMPL_SHARE
      FROM zp WHERE sector = '{S}' AND year NOT IN (1998, 2001) GROUP BY 1, 2"""
)
def median_series(t: Tables):
    """Medians over zones of one sector, some years left out."""
    return rounded(figures.median_series(trade_zone_panel(t), S, (1998, 2001)))


@query(
    f"""WITH {zones_sql()} SELECT e.zone AS CZ_ID, e.sector AS IndustryClassification,
      round(e.labor_share - s.labor_share, 6) AS "D_PSI", round((e.empl - s.empl) / nullif(s.empl, 0), 6) AS "D_EMPL",
      round(e.empl_share - s.empl_share, 6) AS "D_EMPL_SHARE", round(ln(e.hhi_labor) - ln(s.hhi_labor), 6) AS "D_HHI_LABOR",
      round((e.est - s.est) / s.est, 6) AS "D_est", round(ln(e.unempl_rate) - ln(s.unempl_rate), 6) AS "D_unempl_rate",
      round(e.capital_cost_index - s.capital_cost_index, 6) AS "D_capital_cost_index", round(e.union_memb - s.union_memb, 9) AS "D_union_memb"
      FROM zp e LEFT JOIN zp s ON s.zone = e.zone AND s.sector = e.sector AND s.year = 1996 WHERE e.year = 2000 AND e.sector = '{S}'"""
)
def change_table(t: Tables):
    """Long changes of all measures behind the scatter figures."""
    out = figures.change_table(trade_zone_panel(t, capital=True), 1996, 2000, S)
    names = ["D_PSI", "D_EMPL", "D_EMPL_SHARE", "D_HHI_LABOR", "D_est", "D_unempl_rate", "D_capital_cost_index", "D_union_memb"]
    return rounded(out.select(ZONE, SECTOR, *names), 6, D_union_memb=9)


_ZW = "(PARTITION BY zone, sector ORDER BY year)"


@query(
    f"""WITH {zones_sql()}, d AS (SELECT {KEYS}, labor_share - lag(labor_share) OVER {_ZW} AS "D_PSI", empl - lag(empl) OVER {_ZW} AS "D_EMPL",
        empl_share - lag(empl_share) OVER {_ZW} AS "D_EMPL_SHARE", hhi_labor - lag(hhi_labor) OVER {_ZW} AS "D_HHI_LABOR",
        est / empl - lag(est / empl) OVER {_ZW} AS "D_est", ln(capital_cost_index) - lag(ln(capital_cost_index)) OVER {_ZW} AS "D_capital_cost_index",
        union_memb - lag(union_memb) OVER {_ZW} AS "D_union_memb" FROM zp)
      SELECT CZ_ID, IndustryClassification, year, round("D_PSI", 6) AS "D_PSI", round("D_EMPL", 2) AS "D_EMPL", round("D_EMPL_SHARE", 6) AS "D_EMPL_SHARE",
        round("D_HHI_LABOR", 6) AS "D_HHI_LABOR", round("D_est", 6) AS "D_est", round("D_capital_cost_index", 6) AS "D_capital_cost_index",
        round("D_union_memb", 9) AS "D_union_memb", CAST(CASE year WHEN 1997 THEN 2 WHEN 1999 THEN 3 WHEN 2001 THEN 4 ELSE 1 END AS INTEGER) AS time
      FROM d WHERE year <> 1995"""
)
def first_diff_export(t: Tables):
    """First-difference panel with a time index, as handed to another tool."""
    out = figures.difference_export(trade_zone_panel(t, capital=True), {1997: 2, 1999: 3, 2001: 4}, 1995)
    return rounded(out, 6, D_EMPL=2, D_union_memb=9)


@query(
    f"""WITH {zones_sql()} SELECT {KEYS}, round(est / empl, 6) AS firm_count_per_worker,
      CAST(CASE year WHEN 1997 THEN 2 WHEN 1999 THEN 3 WHEN 2001 THEN 4 ELSE 1 END AS INTEGER) AS time FROM zp WHERE empl <> 0"""
)
def did_export(t: Tables):
    """Levels panel with time index and establishments per worker."""
    out = figures.did_export(trade_zone_panel(t), {1997: 2, 1999: 3, 2001: 4})
    return rounded(out.select(ZONE, SECTOR, YEAR, "firm_count_per_worker", "time"))


@query()
def mixture_classes(t: Tables):
    """Customers classified by a Gaussian mixture on their average shares; classes chosen by BIC."""
    p = member_panel(t).groupBy(MEMBER).agg(
        F.avg("LABOR_SHARE").alias("LABOR_SHARE"), F.avg(F.log("HHI_labor")).alias("log_hhi"), F.avg(F.log("EMPL")).alias("log_empl")
    )
    classed, _ = classify(p, ["LABOR_SHARE", "log_hhi", "log_empl"])
    return classed.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


# Estimation samples ------------------------------------------------------------------------------

_POS = "empl > 0 AND est > 0 AND labor_share > 0 AND payroll_share > 0 AND hhi_labor > 0"


@query(
    f"""WITH {zones_sql()} SELECT {KEYS}, round(labor_share - lag(labor_share) OVER {_ZW}, 6) AS "D_LABOR_SHARE",
      round(ln(est) - lag(ln(est)) OVER {_ZW}, 6) AS "D_est", round(hhi_labor - lag(hhi_labor) OVER {_ZW}, 6) AS "D_HHI_labor",
      round(ln(union_memb) - lag(ln(union_memb)) OVER {_ZW}, 6) AS "D_union_memb", round(ln(unempl_rate) - lag(ln(unempl_rate)) OVER {_ZW}, 6) AS "D_unempl_rate",
      round(capital_cost_index - lag(capital_cost_index) OVER {_ZW}, 6) AS "D_capital_cost_index"
      FROM zp WHERE {_POS} AND year <> 1998"""
)
def sample_industry_differences(t: Tables):
    """Row differences by (zone, sector) with one year left out, so that lags span the gap."""
    out = samples.industry_differences(trade_zone_panel(t, capital=True), without=(1998,))
    names = ["D_LABOR_SHARE", "D_est", "D_HHI_labor", "D_union_memb", "D_unempl_rate", "D_capital_cost_index"]
    return rounded(out.select(ZONE, SECTOR, YEAR, *names))


_Z1 = "(PARTITION BY zone ORDER BY year)"


@query(
    f"""WITH {zones_sql()}, w AS (SELECT *, sum(empl) OVER (PARTITION BY zone, year) AS pop FROM zp)
      SELECT zone AS CZ_ID, year, round(ln(payroll_share) - lag(ln(payroll_share)) OVER {_Z1}, 6) AS "D_PSI",
        round(empl_share - lag(empl_share) OVER {_Z1}, 6) AS "D_EMPL_SHARE", round(est - lag(est) OVER {_Z1}, 2) AS "D_est",
        round(est / pop - lag(est / pop) OVER {_Z1}, 6) AS "D_est_per_capita", round(est / gdp * 1e6 - lag(est / gdp * 1e6) OVER {_Z1}, 6) AS "D_est_per_mile",
        round(hhi_labor - lag(hhi_labor) OVER {_Z1}, 6) AS "D_HHI_labor", round(gdp / empl + {NUDGE}, 6) AS productivity
      FROM w WHERE sector = '{S}' AND empl > 0 AND est > 0 AND payroll_share > 0 AND hhi_labor > 0"""
)
def sample_sector_differences(t: Tables):
    """One sector: changes of the payroll share and of establishments per worker, head and area."""
    base = trade_zone_panel(t).withColumn("LAND", F.col("GDP") / 1e6)
    out = samples.sector_differences(base, S, land="LAND").withColumns(
        {"D_est": F.col("D_est").cast("double"), "productivity": F.col("productivity") + F.lit(NUDGE)}
    )
    names = ["D_PSI", "D_EMPL_SHARE", "D_est", "D_est_per_capita", "D_est_per_mile", "D_HHI_labor", "productivity"]
    return rounded(out.select(ZONE, YEAR, *names), 6, D_est=2)


@query(
    f"""WITH {zones_sql()}, w AS (SELECT *, sum(empl) OVER (PARTITION BY zone, year) AS pop FROM zp)
      SELECT zone AS CZ_ID, year, round(payroll_share, 6) AS "PSI", round(est / pop, 6) AS est_per_capita FROM w WHERE sector = '{S}' AND est > 0"""
)
def sample_two_way(t: Tables):
    return rounded(samples.two_way_sample(trade_zone_panel(t), S).select(ZONE, YEAR, "PSI", "est_per_capita"))


@query(
    f"""WITH {zones_sql()}, d AS (SELECT *, ln(hhi_labor) - lag(ln(hhi_labor)) OVER {_ZW} AS dh, empl_share - lag(empl_share) OVER {_ZW} AS de
        FROM zp WHERE sector = '{S}' AND {_POS} AND year <> 1998)
      SELECT zone AS CZ_ID, year, round(first(labor_share) OVER c, 6) AS "L_LABOR_SHARE", round(first(dh) OVER c, 6) AS "L_D_HHI_labor",
        round(first(de) OVER c, 6) AS "L_D_EMPL_SHARE" FROM d
      WINDOW c AS (PARTITION BY zone, sector ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"""
)
def sample_iv(t: Tables):
    """Row differences, then calendar lags of them."""
    out = samples.iv_sample(trade_zone_panel(t, capital=True), S, without=(1998,))
    return rounded(out.select(ZONE, YEAR, "L_LABOR_SHARE", "L_D_HHI_labor", "L_D_EMPL_SHARE"))


@query(
    f"""WITH {zones_sql()} SELECT zone AS CZ_ID, year, round(labor_share, 6) AS "LABOR_SHARE", round(unempl_rate, 9) AS unempl_rate,
      round(hhi_labor, 6) AS "HHI_labor", round(capital_cost_index, 6) AS capital_cost_index, round(union_memb, 9) AS union_memb,
      round(empl_share, 6) AS "EMPL_SHARE" FROM zp WHERE sector = '{S}' AND year NOT IN (1995, 1998) AND hhi_labor > 0 AND labor_share < 1"""
)
def sample_single_equation(t: Tables):
    return rounded(samples.single_equation_sample(trade_zone_panel(t, capital=True), S, (1995, 1998)), 6, union_memb=9, unempl_rate=9)


@query(
    f"""WITH {zones_sql()} SELECT zone AS CZ_ID, year, round(labor_share, 6) AS "LABOR_SHARE", round(unempl_rate, 9) AS unempl_rate,
      round(hhi_labor, 6) AS "HHI_labor", round(capital_cost_index, 6) AS capital_cost_index, round(union_memb, 9) AS union_memb,
      round(empl_share, 6) AS "EMPL_SHARE", round(import_exposure, 6) AS import_exposure FROM zp WHERE sector = '{S}' AND year <> 1995"""
)
def sample_multi_equation(t: Tables):
    return rounded(samples.multi_equation_sample(trade_zone_panel(t, capital=True), S, (1995,)), 6, union_memb=9, unempl_rate=9)


@query(f"WITH {zones_sql()} SELECT zone AS CZ_ID, year, round(labor_share, 6) AS \"LABOR_SHARE\" FROM zp WHERE sector = '{S}' AND year NOT IN (1995, 1998)")
def sample_gmm(t: Tables):
    return rounded(samples.gmm_sample(trade_zone_panel(t), S, (1995, 1998)).select(ZONE, YEAR, "LABOR_SHARE"))
