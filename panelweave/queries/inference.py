"""Robust covariances, tests, tables."""

from pyspark.sql import functions as F

from ..functions import missing
from ..models import diagnostics, gmm as gm, iv as ivm, linear, panel_models as pm, report
from ..operators.panel import CALENDAR, Panel
from ..plans.regional_panel import YEAR
from ..plans.trade_panel import MEMBER, Tables, member_panel
from .estimators import (
    GMM_SQL, RANDOM_SQL, RESULT, X1, X2, Y, Z1, Z2, _CAL1, ab, calendar_differences, coefficients, customers, demeaned, iv_sql,
)
from .gmm_sql import gmm_ctes, test_rows
from .registry import MEMBERS, ols2_sql, query, rounded

STAT = "statistic string, value double"


def statistics(t: Tables, rows, digits: int = 6):
    return rounded(t.spark.createDataFrame([(k, float(v)) for k, v in rows], STAT), digits)


@query(
    f"""WITH {MEMBERS}, {ols2_sql('mp', Y, X1, X2)}, s AS (SELECT *, 1 - rss/syy AS r2 FROM fit)
      SELECT 'nobs' AS statistic, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'df_resid', n - 3.0 FROM s
      UNION ALL SELECT 'sigma', round(sqrt(s2), 6) FROM s UNION ALL SELECT 'r_squared', round(r2, 6) FROM s
      UNION ALL SELECT 'adj_r_squared', round(1 - (1 - r2)*(n - 1)/(n - 3), 6) FROM s
      UNION ALL SELECT 'f_statistic', round((syy - rss)/2/s2, 6) FROM s"""
)
def ols_summary(t: Tables):
    """Fit statistics, all from the moments."""
    s = linear.ols(member_panel(t), Y, [X1, X2]).summary()
    s.pop("f_p_value")
    return statistics(t, s.items())


@query(
    f"""WITH {MEMBERS}, {ols2_sql('mp', Y, X1, X2)}, r AS (SELECT y - b0 - b1*x1 - b2*x2 AS e FROM dd CROSS JOIN fit)
      SELECT round(min(e), 6) AS min, round(quantile_cont(e, 0.25), 6) AS q1, round(median(e), 6) AS median,
        round(quantile_cont(e, 0.75), 6) AS q3, round(max(e), 6) AS max FROM r"""
)
def residual_quantiles(t: Tables):
    """Exact quartiles of the residuals, without gathering them."""
    p = customers(t, Y, X1, X2).df
    fit = linear.ols(p, Y, [X1, X2])
    return rounded(linear.residual_quantiles(fit.with_residuals(p)))


@query(f"WITH {MEMBERS}, {ols2_sql('mp', Y, X1, X2, robust=True)} {RESULT}")
def hc1_se(t: Tables):
    """White errors with the n / (n - k) scale."""
    fit, v = linear.ols_robust(member_panel(t), Y, [X1, X2])
    return coefficients(t, fit, v)


@query(
    f"""WITH {MEMBERS}, {demeaned(Y, X1)}, s AS (SELECT sum({X1}*{Y}) / sum({X1}*{X1}) AS b, sum({X1}*{X1}) AS sxx, count(*) AS n FROM wd),
      c AS (SELECT cust, sum({X1}*({Y} - b*{X1})) AS sc FROM wd CROSS JOIN s GROUP BY 1)
      SELECT '{X1}' AS term, round(max(b), 8) AS estimate, round(sqrt(max(n / (n - 1.0)) * sum(sc*sc)) / max(sxx), 8) AS std_error FROM c CROSS JOIN s"""
)
def cluster_se(t: Tables):
    """Errors clustered by entity for the fixed-effects model."""
    w = pm.within(Panel(member_panel(t), MEMBER, YEAR), Y, [X1])
    return coefficients(t, w.fit, w.cluster_vcov())


# Student tail by Simpson's rule on the density; beyond 40 the tail is zero at any shown digit.
_T_TAIL = """tt AS (SELECT term, estimate, std_error, estimate / std_error AS statistic, n - 3.0 AS df, least(abs(estimate / std_error), 40) AS z FROM res),
  pp AS (SELECT term, sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(lgamma((df + 1)/2) - lgamma(df/2) - 0.5*ln(df*pi()) - (df + 1)/2 * ln(1 + (z*i/4000)*(z*i/4000)/df))) * max(z)/4000/3 AS half
    FROM tt CROSS JOIN range(0, 4001) r(i) GROUP BY term)"""


@query(
    f"""WITH {MEMBERS}, {ols2_sql('mp', Y, X1, X2, robust=True)}, {_T_TAIL}
      SELECT term, round(estimate, 8) AS estimate, round(std_error, 8) AS std_error, round(statistic, 4) AS statistic,
        abs(round(1 - 2*half, 4)) AS p_value FROM tt JOIN pp USING (term)"""
)
def coef_table(t: Tables):
    """Robust coefficient table with p-values, in long form."""
    fit, v = linear.ols_robust(member_panel(t), Y, [X1, X2])
    return rounded(fit.tidy(t.spark, v), 8, statistic=4, p_value=4)


@query(
    f"""WITH {MEMBERS}, {iv_sql('mp', Y, X1, Z1, Z2)},
      a AS (SELECT *, (sxx - hxx) AS rx FROM iv),
      -- y on x and the first-stage residual v: moments of v follow from x and the instruments.
      h AS (SELECT *, rx AS vv, rx AS xv, sxy - (p1*zy1 + p2*zy2) AS yv FROM a),
      w AS (SELECT *, syy - sxy*sxy/sxx AS r0, sxx*vv - xv*xv AS dd FROM h),
      q AS (SELECT *, syy - (vv*sxy*sxy - 2*xv*sxy*yv + sxx*yv*yv)/dd AS r1 FROM w)
      SELECT 'weak_instruments' AS test, 2.0::DOUBLE AS df1, CAST(n - 3 AS DOUBLE) AS df2, round((hxx/2) / (rx/(n - 3)), 6) AS statistic FROM q
      UNION ALL SELECT 'wu_hausman', 1.0, n - 3, round((r0 - r1) / (r1/(n - 3)), 6) FROM q
      UNION ALL SELECT 'sargan', 1.0, NULL, round(n * (a22*u1*u1 - 2*a12*u1*u2 + a11*u2*u2)/det / rss, 6) FROM q"""
)
def iv_diagnostics(t: Tables):
    """Weak instruments, Wu-Hausman, Sargan: functions of the joint moment matrix."""
    fit = ivm.iv(member_panel(t), Y, [X1], [], [Z1, Z2])
    rows = [(n, a, None if b != b else b, s) for n, a, b, s, _ in fit.extra["diagnostics"]]
    return rounded(t.spark.createDataFrame(rows, "test string, df1 double, df2 double, statistic double"))


@query(f"WITH {MEMBERS}, {calendar_differences(Y, Z1, Z2)}, {ols2_sql('fd', Y, Z1, Z2)} {RESULT}")
def reduced_form(t: Tables):
    """Instrument relevance regression on differences."""
    p = Panel(member_panel(t), MEMBER, YEAR)
    return coefficients(t, ivm.reduced_form(pm.differenced(p, [Y, Z1, Z2], CALENDAR), Y, [Z1, Z2]))


@query(f"WITH {MEMBERS}, {GMM_SQL} SELECT 'sargan_onestep' AS statistic, round(jstat1, 6) AS value FROM gz UNION ALL SELECT 'sargan_twostep', round(jstat, 6) FROM gz")
def gmm_sargan(t: Tables):
    """Overidentification statistic of both steps."""
    p = customers(t, Y)
    rows = [(f"sargan_{n}", gm.gmm(p, Y, gmm_lags=(2, 3), steps=k, ar_orders=()).test("sargan")[0]) for k, n in ((1, "onestep"), (2, "twostep"))]
    return statistics(t, rows)


_AR_SQL = " UNION ALL ".join(
    f"""SELECT 'ar{j}' AS statistic, round(sum(c) / sqrt(sum(c*c) - 2*sum(a)*(max(k1)*sum(c*v1) + max(k2)*sum(c*v2)) + sum(a)*sum(a)*max(var1)), 6) AS value
      FROM (SELECT cust, sum(u*w{j}) AS c, sum(w{j}*dx) AS a, sum(z1*u) AS v1, sum(z2*u) AS v2 FROM ar GROUP BY 1) CROSS JOIN gz"""
    for j in (1, 2)
)


@query(
    f"""WITH {MEMBERS}, {GMM_SQL}, eu AS (SELECT ge.*, dy - rho1*dx AS u FROM ge CROSS JOIN r1),
      ar AS (SELECT *, {', '.join(f'coalesce(first(u) OVER (PARTITION BY cust ORDER BY year RANGE BETWEEN {j} PRECEDING AND {j} PRECEDING), 0) AS w{j}' for j in (1, 2))} FROM eu)
      {_AR_SQL}"""
)
def gmm_ar_test(t: Tables):
    """Arellano-Bond tests for first- and second-order serial correlation."""
    fit = ab(t, 1)
    return statistics(t, [(n, fit.test(n)[0]) for n in ("ar1", "ar2")])


@query(f"WITH {MEMBERS}, {GMM_SQL} SELECT 'lag(LABOR_SHARE,1)' AS term, round(rho2, 8) AS estimate, round(sqrt(varw), 8) AS std_error FROM gz")
def gmm_windmeijer(t: Tables):
    """Two-step estimate with Windmeijer's corrected error."""
    return coefficients(t, ab(t, 2).fit)


@query(f"WITH RECURSIVE {MEMBERS}, {gmm_ctes(Y, [X1, X2], (2, 4), system=True)}, {test_rows(3)}")
def gmm_summary(t: Tables):
    """All tests of a two-step system fit."""
    p = customers(t, Y, X1, X2)
    fit = gm.gmm(p, Y, [X1, X2], (2, 4), transformation="ld", steps=2)
    return rounded(fit.tests_frame(t.spark), 6, statistic=3)


@query(
    f"""WITH {MEMBERS}, {RANDOM_SQL},
      rr AS (SELECT cust, year, ({Y} - th*my) - a*(1 - th) - b*({X1} - th*mx) AS r
        FROM (SELECT mp.*, my, mx, a, b, 1 - sqrt(s2e / (t*s2u + s2e)) AS th FROM mp JOIN e USING (cust) CROSS JOIN rs)),
      dw AS (SELECT r, r - lag(r) OVER (PARTITION BY cust ORDER BY year) AS d FROM rr)
      SELECT 'durbin_watson' AS statistic, round(sum(d*d) / sum(r*r), 6) AS value FROM dw"""
)
def durbin_watson_panel(t: Tables):
    """Durbin-Watson statistic of random-effects residuals."""
    stat, _ = diagnostics.durbin_watson(customers(t, Y, X1), Y, [X1])
    return statistics(t, [("durbin_watson", stat)])


@query(
    f"""WITH {MEMBERS}, {RANDOM_SQL},
      rr AS (SELECT cust, year, ({Y} - th*my) - a*(1 - th) - b*({X1} - th*mx) AS r
        FROM (SELECT mp.*, my, mx, a, b, 1 - sqrt(s2e / (t*s2u + s2e)) AS th FROM mp JOIN e USING (cust) CROSS JOIN rs)),
      dw AS (SELECT r, r - lag(r) OVER (ORDER BY cust, year) AS d FROM rr)
      SELECT 'durbin_watson' AS statistic, round(sum(d*d) / sum(r*r), 6) AS value FROM dw"""
)
def durbin_watson_pooled(t: Tables):
    """The same statistic along the whole sorted frame."""
    stat, _ = diagnostics.durbin_watson(customers(t, Y, X1), Y, [X1], across_entities=True)
    return statistics(t, [("durbin_watson", stat)])


@query(
    f"""WITH {MEMBERS}, l AS (SELECT cust, {Y} - lag({Y}) OVER c AS dy, lag({Y}) OVER c AS y1 FROM mp WINDOW c AS (PARTITION BY cust ORDER BY year)),
      s AS (SELECT cust, count(*) AS n, regr_sxx(dy, y1) AS sxx, regr_sxy(dy, y1) AS sxy, regr_syy(dy, y1) AS syy FROM l WHERE dy IS NOT NULL GROUP BY 1 HAVING count(*) > 2),
      r AS (SELECT *, sxy/sxx AS b, syy - sxy*sxy/sxx AS rss FROM s WHERE sxx > 0)
      SELECT cust, n AS nobs, round(b / sqrt(rss/(n - 2)/sxx), 4) AS adf FROM r WHERE rss > 1e-12*syy"""
)
def adf_by_entity(t: Tables):
    """Unit-root regression of every customer."""
    out = diagnostics.adf_by_entity(Panel(member_panel(t), MEMBER, YEAR), Y, pmax=0)
    return rounded(out.select(MEMBER, "nobs", "adf"), 4)


def _table_sql() -> str:
    parts = []
    for name, ctes in (
        ("ols", ols2_sql("mp", Y, X1, X2)),
        ("fd", calendar_differences(Y, X1, X2) + ", " + ols2_sql("fd", Y, X1, X2)),
        ("fe", demeaned(Y, X1, X2) + ", " + ols2_sql("wd", Y, X1, X2, lost="(SELECT count(DISTINCT cust) + 2 FROM mp)", intercept=False)),
    ):
        parts.append(f"{name}_t AS (WITH {ctes} SELECT term, round(estimate, 8) AS {name}_estimate, round(std_error, 8) AS {name}_se FROM res)")
    return f"WITH {MEMBERS}, {', '.join(parts)} SELECT * FROM ols_t FULL JOIN fd_t USING (term) FULL JOIN fe_t USING (term)"


@query(_table_sql())
def model_table(t: Tables):
    """Three models side by side."""
    p = customers(t, Y, X1, X2)
    models = [("ols", linear.ols(p.df, Y, [X1, X2])), ("fd", pm.first_difference(p, Y, [X1, X2])), ("fe", pm.within(p, Y, [X1, X2]).fit)]
    return rounded(report.model_table(t.spark, models), 8)
