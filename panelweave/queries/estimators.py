"""Estimators."""

from pyspark.sql import functions as F

from ..models import gmm as gm, iv as ivm, linear, panel_models as pm
from ..operators.panel import CALENDAR, Panel
from ..plans import samples
from ..plans.regional_panel import SECTOR, YEAR, ZONE
from ..plans.trade_panel import MEMBER, Tables, member_panel, trade_zone_panel
from ..session import materialise
from .gmm_sql import RESULT as GMM_RESULT, gmm_ctes
from .registry import MEMBERS, ols2_sql, query, rounded, zones_sql

Y, X1, X2 = "LABOR_SHARE", "HHI_labor", "unempl_rate"
Z1, Z2 = "est_per_worker", "import_exposure"
RESULT = "SELECT term, round(estimate, 8) AS estimate, round(std_error, 8) AS std_error FROM res"


def customers(t: Tables, *columns: str) -> Panel:
    """Customer x year panel with the model columns only, computed once for all passes of a fit."""
    return Panel(materialise(member_panel(t).select(MEMBER, YEAR, *columns)), MEMBER, YEAR)


def zones(t: Tables, *columns: str) -> Panel:
    return Panel(materialise(trade_zone_panel(t).select(ZONE, SECTOR, YEAR, *columns)), [ZONE, SECTOR], YEAR)


def coefficients(t: Tables, fit, vcov=None):
    return rounded(fit.tidy(t.spark, vcov).select("term", "estimate", "std_error"), 8)


@query(f"WITH {MEMBERS}, {ols2_sql('mp', Y, X1, X2)} {RESULT}")
def ols(t: Tables):
    """Pooled least squares: one aggregate over the panel."""
    return coefficients(t, linear.ols(member_panel(t), Y, [X1, X2]))


_ZW = "(PARTITION BY zone, sector ORDER BY year)"
_ZDIFF = f"""zd AS (SELECT zone, sector AS "Industry", labor_share - lag(labor_share) OVER {_ZW} AS "D_LABOR_SHARE",
  hhi_labor - lag(hhi_labor) OVER {_ZW} AS "D_HHI_labor", ln(unempl_rate) - lag(ln(unempl_rate)) OVER {_ZW} AS "D_unempl_rate"
  FROM zp WHERE empl > 0 AND est > 0 AND labor_share > 0 AND payroll_share > 0 AND hhi_labor > 0 AND unempl_rate > 0 AND year <> 1995)"""


@query(
    f"""WITH {zones_sql()}, {_ZDIFF}, {ols2_sql('zd', '"D_LABOR_SHARE"', '"D_HHI_labor"', '"D_unempl_rate"', by='"Industry"', robust=True)}
      SELECT "Industry", replace(term, '"', '') AS term, round(estimate, 8) AS estimate, round(std_error, 8) AS std_error,
        round(estimate / std_error, 4) AS statistic, n AS nobs FROM res"""
)
def grouped_ols(t: Tables):
    """First-difference regression per sector with robust errors, all sectors in one job."""
    out = samples.industry_coefficients(trade_zone_panel(t), ["D_HHI_labor", "D_unempl_rate"], without=(1995,))
    return rounded(out.drop("p_value"), 8, statistic=4)


def calendar_differences(*columns: str) -> str:
    cal = "(PARTITION BY cust ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    cols = ", ".join(f"{c} - first({c}) OVER {cal} AS {c}" for c in columns)
    return f"fd AS (SELECT cust, year, {cols} FROM mp)"


@query(f"WITH {MEMBERS}, {calendar_differences(Y, X1, X2)}, {ols2_sql('fd', Y, X1, X2)} {RESULT}")
def fd(t: Tables):
    """First-difference model, intercept kept."""
    return coefficients(t, pm.first_difference(Panel(member_panel(t), MEMBER, YEAR), Y, [X1, X2], CALENDAR))


_LAGS = "lg AS (SELECT cust, year, {y}, first({y}) OVER {w} AS \"L_LABOR_SHARE\", first({x}) OVER {w} AS \"L_HHI_labor\" FROM mp)".format(
    y=Y, x=X1, w="(PARTITION BY cust ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
)


@query(
    f"""WITH {MEMBERS}, {_LAGS}, {calendar_differences(Y, '"L_LABOR_SHARE"', '"L_HHI_labor"').replace('FROM mp', 'FROM lg')},
      {ols2_sql('fd', Y, 'L_LABOR_SHARE', 'L_HHI_labor')} {RESULT}"""
)
def fd_dynamic(t: Tables):
    """First-difference model with the lagged outcome and a lagged regressor."""
    p = Panel(member_panel(t).select(MEMBER, YEAR, Y, X1), MEMBER, YEAR)
    p = p.with_columns({"L_LABOR_SHARE": p.calendar_lag(Y), "L_HHI_labor": p.calendar_lag(X1)})
    return coefficients(t, pm.first_difference(p, Y, ["L_LABOR_SHARE", "L_HHI_labor"], CALENDAR))


def demeaned(*columns: str) -> str:
    cols = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY cust) AS {c}" for c in columns)
    return f"wd AS (SELECT cust, year, {cols} FROM mp)"


@query(
    f"WITH {MEMBERS}, {demeaned(Y, X1, X2)}, "
    + ols2_sql("wd", Y, X1, X2, lost="(SELECT count(DISTINCT cust) + 2 FROM mp)", intercept=False)
    + " "
    + RESULT
)
def within_oneway(t: Tables):
    """Fixed-effects model from one moment row per customer."""
    return coefficients(t, pm.within(Panel(member_panel(t), MEMBER, YEAR), Y, [X1, X2]).fit)


def double_demeaned(*columns: str) -> str:
    """Two-way transform, valid on the dense zone panel."""
    cols = ", ".join(
        f"{c} - avg({c}) OVER (PARTITION BY zone, sector) - avg({c}) OVER (PARTITION BY year) + avg({c}) OVER () AS {c}" for c in columns
    )
    return f"wd AS (SELECT zone, sector, year, {cols} FROM zp)"


_LOST = "(SELECT count(DISTINCT (zone, sector)) + count(DISTINCT year) - 1 + {k} FROM zp)"


@query(
    f"WITH {zones_sql()}, {double_demeaned(Y, X1, X2)}, "
    + ols2_sql("wd", Y, X1, X2, lost=_LOST.format(k=2), intercept=False)
    + " "
    + RESULT
)
def within_twoway(t: Tables):
    """Entity and period effects; the dense panel makes the SQL a double demeaning."""
    return coefficients(t, pm.within(Panel(trade_zone_panel(t), [ZONE, SECTOR], YEAR), Y, [X1, X2], pm.TWOWAYS).fit)


def _projected(columns, rounds: int = 25) -> str:
    """Two-way transform of the gapped panel by repeated demeaning, which converges to it."""
    ctes, source = [], "mp"
    for i in range(rounds):
        for key in ("cust", "year"):
            cols = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {key}) AS {c}" for c in columns)
            ctes.append(f"w{i}{key} AS (SELECT cust, year, {cols} FROM {source})")
            source = f"w{i}{key}"
    return ", ".join(ctes) + f", wd AS (SELECT * FROM {source})"


@query(
    f"WITH {MEMBERS}, {_projected([Y, X1, X2])}, "
    + ols2_sql("wd", Y, X1, X2, lost="(SELECT count(DISTINCT cust) + count(DISTINCT year) + 1 FROM mp)", intercept=False)
    + " "
    + RESULT
)
def within_twoway_unbalanced(t: Tables):
    """Two-way model on the gapped customer panel, exact by its normal equations."""
    return coefficients(t, pm.within(Panel(member_panel(t), MEMBER, YEAR), Y, [X1, X2], pm.TWOWAYS).fit)


_CAL1 = "(PARTITION BY cust ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"


@query(
    f"""WITH {MEMBERS}, dy AS (SELECT cust, year, {Y}, {X1}, first({Y}) OVER {_CAL1} AS "L_LABOR_SHARE" FROM mp),
      ok AS (SELECT * FROM dy WHERE "L_LABOR_SHARE" IS NOT NULL),
      wd AS (SELECT cust, {Y} - avg({Y}) OVER c AS {Y}, {X1} - avg({X1}) OVER c AS {X1}, "L_LABOR_SHARE" - avg("L_LABOR_SHARE") OVER c AS "L_LABOR_SHARE"
        FROM ok WINDOW c AS (PARTITION BY cust)), """
    + ols2_sql("wd", Y, "L_LABOR_SHARE", X1, lost="(SELECT count(DISTINCT cust) + 2 FROM ok)", intercept=False)
    + " "
    + RESULT
)
def within_dynamic(t: Tables):
    """Fixed-effects model with the calendar-lagged outcome among the regressors."""
    p = Panel(member_panel(t).select(MEMBER, YEAR, Y, X1), MEMBER, YEAR)
    p = p.with_columns({"L_LABOR_SHARE": p.calendar_lag(Y)})
    return coefficients(t, pm.within(p, Y, ["L_LABOR_SHARE", X1]).fit)


RANDOM_SQL = f"""e AS (SELECT cust, count(*) AS t, avg({Y}) AS my, avg({X1}) AS mx, regr_sxx({Y}, {X1}) AS sxx,
  regr_sxy({Y}, {X1}) AS sxy, regr_syy({Y}, {X1}) AS syy FROM mp GROUP BY 1),
w AS (SELECT count(*) AS n, sum(t) AS nn, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy,
  sum(t*mx) AS b01, sum(t*mx*mx) AS b11, sum(t*my) AS c0, sum(t*mx*my) AS c1, sum(t*my*my) AS cc,
  sum(t*t) AS q00, sum(t*t*mx) AS q01, sum(t*t*mx*mx) AS q11 FROM e),
v AS (SELECT *, (syy - sxy*sxy/sxx) / (nn - n - 1) AS s2e, nn*b11 - b01*b01 AS det,
  cc - (b11*c0*c0 - 2*b01*c0*c1 + nn*c1*c1) / (nn*b11 - b01*b01) AS rssb,
  (b11*q00 - 2*b01*q01 + nn*q11) / (nn*b11 - b01*b01) AS trace FROM w),
u AS (SELECT *, greatest((rssb - (n - 2)*s2e) / (nn - trace), 0) AS s2u FROM v),
g AS (SELECT s2e, s2u, nn, sum(h) AS g00, sum(h*mx) AS g01, sum(h*mx*mx + e.sxx) AS g11, sum(h*my) AS y0, sum(h*mx*my + e.sxy) AS y1,
  sum(h*my*my + e.syy) AS yy FROM (SELECT e.*, s2e, s2u, nn, t*s2e/(t*s2u + s2e) AS h FROM e CROSS JOIN u) e GROUP BY 1, 2, 3),
re AS (SELECT *, g00*g11 - g01*g01 AS dd, (g11*y0 - g01*y1) / (g00*g11 - g01*g01) AS a, (g00*y1 - g01*y0) / (g00*g11 - g01*g01) AS b FROM g),
rs AS (SELECT *, (yy - a*y0 - b*y1) / (nn - 2) AS s2 FROM re)"""


@query(
    f"""WITH {MEMBERS}, {RANDOM_SQL}
      SELECT '(Intercept)' AS term, round(a, 8) AS estimate, round(sqrt(s2*g11/dd), 8) AS std_error FROM rs
      UNION ALL SELECT '{X1}', round(b, 8), round(sqrt(s2*g00/dd), 8) FROM rs"""
)
def random_effects(t: Tables):
    """Swamy-Arora random effects on the unbalanced customer panel."""
    return coefficients(t, pm.random_effects(Panel(member_panel(t), MEMBER, YEAR), Y, [X1]).fit)


def iv_sql(source: str, y: str, x: str, z1: str, z2: str, lost: str = "2", intercept: bool = True) -> str:
    """CTEs up to ``iv`` and ``res`` for one endogenous regressor and two instruments."""
    out = f"""ii AS (SELECT {y} AS y, {x} AS x, {z1} AS z1, {z2} AS z2 FROM {source}
  WHERE {y} IS NOT NULL AND {x} IS NOT NULL AND {z1} IS NOT NULL AND {z2} IS NOT NULL),
im AS (SELECT count(*) AS n, avg(y) AS my, avg(x) AS mx, regr_sxx(y, z1) AS a11, regr_sxx(y, z2) AS a22, regr_sxy(z1, z2) AS a12,
  regr_sxy(x, z1) AS zx1, regr_sxy(x, z2) AS zx2, regr_sxy(y, z1) AS zy1, regr_sxy(y, z2) AS zy2,
  regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM ii),
i1 AS (SELECT *, a11*a22 - a12*a12 AS det, (a22*zx1 - a12*zx2) / (a11*a22 - a12*a12) AS p1, (a11*zx2 - a12*zx1) / (a11*a22 - a12*a12) AS p2 FROM im),
i2 AS (SELECT *, p1*zx1 + p2*zx2 AS hxx, (p1*zy1 + p2*zy2) / (p1*zx1 + p2*zx2) AS b FROM i1),
iv AS (SELECT *, syy - 2*b*sxy + b*b*sxx AS rss, (syy - 2*b*sxy + b*b*sxx) / (n - {lost}) AS s2, zy1 - b*zx1 AS u1, zy2 - b*zx2 AS u2 FROM i2),
res AS (SELECT '{x}' AS term, b AS estimate, sqrt(s2/hxx) AS std_error FROM iv"""
    if intercept:
        out += " UNION ALL SELECT '(Intercept)', my - b*mx, sqrt(s2*(1.0/n + mx*mx/hxx)) FROM iv"
    return out + ")"


@query(f"WITH {MEMBERS}, {iv_sql('mp', Y, X1, Z1, Z2)} {RESULT}")
def iv_2sls(t: Tables):
    """Two-stage least squares from one joint moment matrix."""
    return coefficients(t, ivm.iv(member_panel(t), Y, [X1], [], [Z1, Z2]))


@query(
    f"""WITH {zones_sql()}, d AS (SELECT *, labor_share - lag(labor_share) OVER {_ZW} AS dy, ln(hhi_labor) - lag(ln(hhi_labor)) OVER {_ZW} AS dx,
        empl_share - lag(empl_share) OVER {_ZW} AS dz FROM zp WHERE sector = 'FURNITURE' AND empl > 0 AND est > 0 AND labor_share > 0 AND payroll_share > 0 AND hhi_labor > 0),
      l AS (SELECT dy AS y, first(dx) OVER c AS x, first(dz) OVER c AS z FROM d WINDOW c AS (PARTITION BY zone, sector ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)),
      k AS (SELECT * FROM l WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL),
      s AS (SELECT count(*) AS n, avg(y) AS my, avg(x) AS mx, regr_sxy(y, z) AS zy, regr_sxy(x, z) AS zx, regr_sxx(y, z) AS zz, regr_sxx(y, x) AS xx,
        regr_sxy(y, x) AS xy, regr_syy(y, x) AS yy FROM k),
      r AS (SELECT *, zy/zx AS b, (yy - 2*zy/zx*xy + zy/zx*zy/zx*xx) / (n - 2) AS s2, zx*zx/zz AS h FROM s)
      SELECT 'L_D_HHI_labor' AS term, round(b, 6) AS estimate, round(sqrt(s2/h), 6) AS std_error FROM r
      UNION ALL SELECT '(Intercept)', round(my - b*mx, 6), round(sqrt(s2*(1.0/n + mx*mx/h)), 6) FROM r"""
)
def iv_lagged(t: Tables):
    """2SLS of the change of the labour share on lagged changes, in one sector."""
    base = trade_zone_panel(t).withColumn("capital_cost_index", F.lit(1.0))
    frame = samples.iv_sample(base, "FURNITURE", without=())
    fit = ivm.iv(frame, "D_LABOR_SHARE", ["L_D_HHI_labor"], [], ["L_D_EMPL_SHARE"])
    return rounded(coefficients(t, fit), 6)


@query(
    f"WITH {zones_sql()}, {double_demeaned(Y, X1, 'EMPL_SHARE', Z2)}, {iv_sql('wd', Y, X1, 'EMPL_SHARE', Z2, _LOST.format(k=1), False)} {RESULT}"
)
def iv_within(t: Tables):
    """2SLS with entity and period effects."""
    p = Panel(trade_zone_panel(t), [ZONE, SECTOR], YEAR)
    return coefficients(t, ivm.iv_within(p, Y, [X1], [], ["EMPL_SHARE", Z2]))


@query(
    f"WITH {zones_sql()}, {double_demeaned(X1, 'EMPL_SHARE', Z2)}, "
    + ols2_sql("wd", X1, "EMPL_SHARE", Z2, lost=_LOST.format(k=2), intercept=False)
    + " "
    + RESULT
)
def iv_first_stage(t: Tables):
    """First stage of the two-way 2SLS as its own model."""
    return coefficients(t, pm.within(Panel(trade_zone_panel(t), [ZONE, SECTOR], YEAR), X1, ["EMPL_SHARE", Z2], pm.TWOWAYS).fit)


@query(f"WITH {MEMBERS}, {calendar_differences(Y, X1, Z1, Z2)}, {iv_sql('fd', Y, X1, Z1, Z2)} {RESULT}")
def iv_fd(t: Tables):
    """2SLS on first differences."""
    return coefficients(t, ivm.iv_first_difference(Panel(member_panel(t), MEMBER, YEAR), Y, [X1], [], [Z1, Z2]))


# GMM: lagged outcome only, instruments lags 2 and 3 collapsed, in closed form. -------------------

GMM_SQL = f"""gl AS (SELECT cust, year, {Y} AS y0, {', '.join(f'first({Y}) OVER (PARTITION BY cust ORDER BY year RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) AS y{k}' for k in (1, 2, 3))} FROM mp),
ge AS (SELECT cust, year, y0 - y1 AS dy, y1 - y2 AS dx, y2 AS z1, coalesce(y3, 0) AS z2 FROM gl WHERE y1 IS NOT NULL AND y2 IS NOT NULL),
gp AS (SELECT *, coalesce(first(z1) OVER c, 0) AS p1, coalesce(first(z2) OVER c, 0) AS p2 FROM ge
  WINDOW c AS (PARTITION BY cust ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)),
ga AS (SELECT sum(z1*dx) AS a1, sum(z2*dx) AS a2, sum(z1*dy) AS b1, sum(z2*dy) AS b2, 2*sum(z1*z1) - 2*sum(z1*p1) AS h11,
  2*sum(z2*z2) - 2*sum(z2*p2) AS h22, 2*sum(z1*z2) - sum(z1*p2) - sum(z2*p1) AS h12, count(*) AS n FROM gp),
g1 AS (SELECT *, (h22*a1 - h12*a2) / (a1*(h22*a1 - h12*a2) + a2*(h11*a2 - h12*a1)) AS k1,
  (h11*a2 - h12*a1) / (a1*(h22*a1 - h12*a2) + a2*(h11*a2 - h12*a1)) AS k2 FROM ga),
r1 AS (SELECT *, k1*b1 + k2*b2 AS rho1 FROM g1),
gs AS (SELECT cust, sum(z1*(dy - rho1*dx)) AS v1, sum(z2*(dy - rho1*dx)) AS v2, sum(z1*dx) AS x1, sum(z2*dx) AS x2 FROM ge CROSS JOIN r1 GROUP BY 1),
go AS (SELECT sum(v1*v1) AS o11, sum(v1*v2) AS o12, sum(v2*v2) AS o22, sum(v1*x1) AS c11, sum(v1*x2) AS c12, sum(v2*x1) AS c21, sum(v2*x2) AS c22 FROM gs),
g2 AS (SELECT r1.*, go.*, k1*k1*o11 + 2*k1*k2*o12 + k2*k2*o22 AS var1, o11*o22 - o12*o12 AS det FROM r1 CROSS JOIN go),
g3 AS (SELECT *, o22/det AS w11, -o12/det AS w12, o11/det AS w22 FROM g2),
g4 AS (SELECT *, a1*a1*w11 + 2*a1*a2*w12 + a2*a2*w22 AS q FROM g3),
g5 AS (SELECT *, (w11*a1 + w12*a2)/q AS j1, (w12*a1 + w22*a2)/q AS j2 FROM g4),
g6 AS (SELECT *, j1*b1 + j2*b2 AS rho2 FROM g5),
g7 AS (SELECT *, b1 - rho2*a1 AS m1, b2 - rho2*a2 AS m2, b1 - rho1*a1 AS f1, b2 - rho1*a2 AS f2 FROM g6),
g8 AS (SELECT *, m1*m1*w11 + 2*m1*m2*w12 + m2*m2*w22 AS jstat, f1*f1*w11 + 2*f1*f2*w12 + f2*f2*w22 AS jstat1,
  w11*m1 + w12*m2 AS t1, w12*m1 + w22*m2 AS t2 FROM g7),
g9 AS (SELECT *, 2*j1*c11*t1 + j1*(c12 + c21)*t2 + j2*(c12 + c21)*t1 + 2*j2*c22*t2 AS d FROM g8),
gz AS (SELECT *, 1/q + 2*d/q + d*d*var1 AS varw FROM g9)"""


def ab(t: Tables, steps: int, robust: bool = True):
    return gm.gmm(customers(t, Y), Y, gmm_lags=(2, 3), steps=steps, robust=robust)


@query(f"WITH {MEMBERS}, {GMM_SQL} SELECT 'lag(LABOR_SHARE,1)' AS term, round(rho1, 8) AS estimate, round(sqrt(var1), 8) AS std_error FROM gz")
def gmm_diff_onestep(t: Tables):
    """Arellano-Bond, one step, collapsed instruments, robust errors."""
    return coefficients(t, ab(t, 1).fit)


@query(f"WITH {MEMBERS}, {GMM_SQL} SELECT 'lag(LABOR_SHARE,1)' AS term, round(rho2, 8) AS estimate, round(sqrt(1/q), 8) AS std_error FROM gz")
def gmm_diff_twostep(t: Tables):
    """Arellano-Bond, two steps, collapsed instruments, classical errors."""
    return coefficients(t, ab(t, 2, robust=False).fit)


@query(f"WITH RECURSIVE {MEMBERS}, {gmm_ctes(Y, [X1, X2], (2, 3), [X2, Z1, Z2], collapse=False)} {GMM_RESULT}")
def gmm_diff_block(t: Tables):
    """Two steps, one instrument per period and lag, external instruments in place of a regressor."""
    p = customers(t, Y, X1, X2, Z1, Z2)
    return coefficients(t, gm.gmm(p, Y, [X1, X2], (2, 3), [X2, Z1, Z2], steps=2, collapse=False).fit)


@query(f"WITH RECURSIVE {MEMBERS}, {gmm_ctes(X1, [Z1, Z2], (3, 4))} {GMM_RESULT}")
def gmm_concentration(t: Tables):
    """Two-step equation for concentration with lags 3 to 4, collapsed."""
    p = customers(t, X1, Z1, Z2)
    return coefficients(t, gm.gmm(p, X1, [Z1, Z2], (3, 4), steps=2).fit)


@query(f"WITH RECURSIVE {MEMBERS}, {gmm_ctes(Y, [(X1, 1), (X2, 1)], (3, 20), system=True)} {GMM_RESULT}")
def gmm_system(t: Tables):
    """Two-step system GMM with lagged regressors, collapsed instruments from lag 3."""
    p = customers(t, Y, X1, X2)
    return coefficients(t, gm.gmm(p, Y, [(X1, 1), (X2, 1)], (3, 20), transformation="ld", steps=2).fit)


@query(f"WITH RECURSIVE {MEMBERS}, {gmm_ctes(X1, [], (2, 11), system=True, steps=1, collapse=False, twoways=True)} {GMM_RESULT}")
def gmm_persistence(t: Tables):
    """One-step system GMM with period effects, one instrument per period and lag."""
    p = customers(t, X1)
    fit = gm.gmm(p, X1, (), (2, 11), transformation="ld", steps=1, collapse=False, effect="twoways").fit
    return coefficients(t, fit)
