"""Models at the edges: aliased regressors, long calendars, serial correlation p-values, functions of groups."""

from pyspark.sql import functions as F

from ..models import iv as ivm, linear, panel_models as pm, serial
from ..models.mixture_families import mixture_families as fit_families
from ..operators.grouped import Grouped, apply_grouped
from ..operators.panel import Panel
from ..plans.regional_panel import YEAR
from ..plans.trade_panel import MEMBER, Tables, member_panel
from ..session import materialise
from .estimators import RANDOM_SQL, RESULT, X1, X2, Y, Z1, Z2, coefficients, customers, demeaned, iv_sql
from .registry import MEMBERS, ols2_sql, query, rounded

# Aliased regressors ----------------------------------------------------------------------------

#: Regressors that others explain, and how.
TWICE, ROUND = "twice", "round"


def _none(*terms: str) -> str:
    return "".join(f" UNION ALL SELECT '{t}', NULL, NULL" for t in terms)


@query(f"WITH {MEMBERS}, {ols2_sql('mp', Y, X1, X2)} {RESULT}{_none(TWICE, ROUND)}")
def ols_aliased(t: Tables):
    """Least squares with two regressors that the others explain: their rows are NULL, the rest as without them."""
    df = member_panel(t).select(Y, X1, X2).withColumns({TWICE: F.expr(f"2 * {X1} - {X2} + 3"), ROUND: F.lit(5.0)})
    return coefficients(t, linear.ols(df, Y, [X1, X2, TWICE, ROUND]))


@query(
    f"WITH {MEMBERS}, {demeaned(Y, X1, X2)}, "
    + ols2_sql("wd", Y, X1, X2, lost="(SELECT count(DISTINCT cust) + 2 FROM mp)", intercept=False)
    + f" {RESULT}{_none(TWICE, ROUND)}"
)
def within_aliased(t: Tables):
    """Fixed effects with a regressor that is constant in each customer and one that others explain."""
    df = member_panel(t).select(MEMBER, YEAR, Y, X1, X2)
    df = df.withColumns({TWICE: F.expr(f"2 * {X1} - {X2}"), ROUND: (F.col(MEMBER) % 7 + 1000).cast("double")})
    return coefficients(t, pm.within(Panel(materialise(df), MEMBER, YEAR), Y, [X1, X2, TWICE, ROUND]).fit)


@query(f"WITH {MEMBERS}, {iv_sql('mp', Y, X1, Z1, Z2)} {RESULT}{_none(ROUND)}")
def iv_aliased(t: Tables):
    """2SLS with an instrument that the others explain and a constant regressor."""
    df = member_panel(t).select(Y, X1, Z1, Z2).withColumns({TWICE: F.expr(f"{Z1} + {Z2}"), ROUND: F.lit(2.0)})
    return coefficients(t, ivm.iv(df, Y, [X1], [ROUND], [Z1, Z2, TWICE]))


# Serial correlation ----------------------------------------------------------------------------

_RESIDUALS = f"""rr AS (SELECT cust, year, t, ({Y} - th*my) - a*(1 - th) - b*({X1} - th*mx) AS r, 1 - th AS q0, {X1} - th*mx AS q1,
    row_number() OVER (PARTITION BY cust ORDER BY year) AS pos
  FROM (SELECT mp.*, t, my, mx, a, b, 1 - sqrt(s2e / (t*s2u + s2e)) AS th FROM mp JOIN e USING (cust) CROSS JOIN rs))"""

# The characteristic function of the two quadratic forms' difference, with the regressors' part as a complex 2 x 2
# determinant, inverted by Simpson's rule in units of the standard deviation.
_INVERSION = """dw AS (SELECT r, r - lag(r) OVER (PARTITION BY cust ORDER BY year) AS d FROM rr),
st AS (SELECT sum(d*d) / sum(r*r) AS dw FROM dw),
wave AS (SELECT cust, t, j, sum(c*q0) AS g0, sum(c*q1) AS g1 FROM (
    SELECT cust, t, j, q0, q1, CASE WHEN j = 0 THEN sqrt(1.0/t) ELSE sqrt(2.0/t) * cos(pi()*(pos - 0.5)*j/t) END AS c
    FROM rr, (SELECT unnest(range(0, 100)) AS j) WHERE j < t) GROUP BY 1, 2, 3),
sp AS (SELECT 2 - 2*cos(pi()*j/t) - max(dw) AS mu, count(*) AS c, sum(g0*g0) AS s00, sum(g0*g1) AS s01, sum(g1*g1) AS s11 FROM wave CROSS JOIN st GROUP BY t, j),
tot AS (SELECT sum(s00) AS a, sum(s01) AS b, sum(s11) AS d, sqrt(2*sum(c*mu*mu)) AS sd FROM sp),
grid AS (SELECT i, i * 12.0 / 6000 AS u FROM (SELECT unnest(range(1, 6001)) AS i)),
cf AS (SELECT i, u, any_value(a*d - b*b) AS whole, sum(c * ln(1 + 4*s*s*mu*mu)) / 2 AS logr, sum(c * atan(2*s*mu)) AS arg,
    sum(s00/(1 + 4*s*s*mu*mu)) AS ar, sum(s00*2*s*mu/(1 + 4*s*s*mu*mu)) AS ai, sum(s01/(1 + 4*s*s*mu*mu)) AS br, sum(s01*2*s*mu/(1 + 4*s*s*mu*mu)) AS bi,
    sum(s11/(1 + 4*s*s*mu*mu)) AS dr, sum(s11*2*s*mu/(1 + 4*s*s*mu*mu)) AS di
  FROM (SELECT i, u, u/sd AS s, mu, c, s00, s01, s11, a, b, d FROM grid CROSS JOIN tot CROSS JOIN sp) GROUP BY i, u),
-- log E = -(log |C| + log det K - log whole) / 2, where |C| has argument -arg.
el AS (SELECT i, u, (ar*dr - ai*di - br*br + bi*bi)/whole AS kr, (ar*di + ai*dr - 2*br*bi)/whole AS ki, logr, arg FROM cf),
im AS (SELECT i, exp(-(logr + ln(kr*kr + ki*ki)/2)/2) * sin(-(-arg + atan2(ki, kr))/2) / u AS f FROM el),
-- At zero the integrand is the mean over the standard deviation; the first interval uses it.
ze AS (SELECT (sum(c*mu) - (any_value(d)*sum(s00*mu) - 2*any_value(b)*sum(s01*mu) + any_value(a)*sum(s11*mu)) / any_value(a*d - b*b)) / any_value(sd) AS f FROM sp CROSS JOIN tot),
si AS (SELECT (max(ze.f) + sum(CASE WHEN i = 6000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * im.f)) * 12.0/6000/3 AS total FROM im CROSS JOIN ze)"""


@query(
    f"""WITH {MEMBERS}, {RANDOM_SQL}, {_RESIDUALS}, {_INVERSION}
      SELECT round(dw, 6) AS statistic, round(0.5 - total/pi(), 6) AS p_value FROM st CROSS JOIN si"""
)
def durbin_watson_exact(t: Tables):
    """Panel Durbin-Watson test with its exact p-value: the distribution of a ratio of quadratic forms."""
    out = serial.durbin_watson_test(customers(t, Y, X1), Y, [X1])
    return rounded(t.spark.createDataFrame([(out["statistic"], out["p_value"])], "statistic double, p_value double"), 6)


@query(
    f"""WITH {MEMBERS}, {RANDOM_SQL}, {_RESIDUALS},
      nb AS (SELECT *, lag(r) OVER o AS lr, lag(q0) OVER o AS l0, lag(q1) OVER o AS l1, lead(q0) OVER o AS n0, lead(q1) OVER o AS n1 FROM rr WINDOW o AS (ORDER BY cust, year)),
      df AS (SELECT r, q0, q1, r - lr AS dr, q0 - l0 AS d0, q1 - l1 AS d1, coalesce(q0 - l0, 0) + coalesce(q0 - n0, 0) AS a0, coalesce(q1 - l1, 0) + coalesce(q1 - n1, 0) AS a1 FROM nb),
      sm AS (SELECT count(*)::DOUBLE AS n, sum(dr*dr)/sum(r*r) AS dw, sum(q0*q0) AS x00, sum(q0*q1) AS x01, sum(q1*q1) AS x11, sum(d0*d0) AS y00, sum(d0*d1) AS y01, sum(d1*d1) AS y11,
        sum(a0*a0) AS z00, sum(a0*a1) AS z01, sum(a1*a1) AS z11 FROM df),
      iv AS (SELECT *, x11/(x00*x11 - x01*x01) AS i00, -x01/(x00*x11 - x01*x01) AS i01, x00/(x00*x11 - x01*x01) AS i11 FROM sm),
      fm AS (SELECT *, y00*i00 + y01*i01 AS f00, y00*i01 + y01*i11 AS f01, y01*i00 + y11*i01 AS f10, y01*i01 + y11*i11 AS f11 FROM iv),
      pq AS (SELECT *, 2*(n - 1) - f00 - f11 AS p, 2*(3*n - 4) - 2*(z00*i00 + 2*z01*i01 + z11*i11) + f00*f00 + 2*f01*f10 + f11*f11 AS q FROM fm),
      mv AS (SELECT dw, p/(n - 2) AS m, 2/((n - 2)*n) * (q - p*p/(n - 2)) AS v FROM pq)
      SELECT round(dw, 6) AS statistic, round(m, 6) AS mean, round(v, 9) AS variance FROM mv"""
)
def durbin_watson_along_frame(t: Tables):
    """The test along the whole sorted frame, with the moments behind its normal approximation."""
    out = serial.durbin_watson_test(customers(t, Y, X1), Y, [X1], across_entities=True)
    row = [(out["statistic"], out["mean"], out["variance"])]
    return rounded(t.spark.createDataFrame(row, "statistic double, mean double, variance double"), 6, variance=9)


# Long calendars --------------------------------------------------------------------------------

_DAILY = """dy AS (SELECT o_custkey AS cust, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day,
    ln(sum(l_extendedprice)) AS y, avg(l_discount) AS x1, avg(l_quantity) AS x2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _swept(columns: tuple[str, ...], rounds: int) -> str:
    """Two-way transform by repeated demeaning in one recursive query."""
    start = ", ".join(columns)
    by = lambda key: ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {key}) AS {c}" for c in columns)
    return (
        f"sw(k, cust, day, {start}) AS (SELECT 0, cust, day, {start} FROM dy UNION ALL"
        f" SELECT k + 1, cust, day, {by('day')} FROM (SELECT k, cust, day, {by('cust')} FROM sw WHERE k < {rounds})),"
        f" wd AS (SELECT cust, day, {by('cust')} FROM sw WHERE k = {rounds})"
    )


@query(
    f"WITH RECURSIVE {_DAILY}, {_swept(('y', 'x1', 'x2'), 250)}, "
    + ols2_sql("wd", "y", "x1", "x2", lost="(SELECT count(DISTINCT cust) + count(DISTINCT day) + 1 FROM dy)", intercept=False)
    + " SELECT term, round(estimate, 7) AS estimate, round(std_error, 7) AS std_error FROM res"
)
def within_twoway_daily(t: Tables):
    """Two-way model over days: thousands of period effects by conjugate gradients over the rows."""
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias(MEMBER), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"))
    daily = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(MEMBER, "day")
    daily = daily.agg(F.ln(F.sum("l_extendedprice")).alias("y"), F.avg("l_discount").alias("x1"), F.avg("l_quantity").alias("x2"))
    return rounded(coefficients(t, pm.within(Panel(materialise(daily), MEMBER, "day"), "y", ["x1", "x2"], pm.TWOWAYS).fit), 7)


# Functions of groups ---------------------------------------------------------------------------


def _line(y: str, x: str) -> Grouped:
    """Slope and squared correlation, as a state of a count, means and centred products."""
    import numpy as np

    def merge(a, b):
        n = a[0] + b[0]
        if not n:
            return a
        d = b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    def add(state, columns):
        z = np.column_stack([columns[y], columns[x]])
        mean = z.mean(axis=0)
        return merge(state, (len(z), mean, (z - mean).T @ (z - mean)))

    def finish(state):
        n, _, s = state
        return [(n, float(s[0, 1] / s[1, 1]), float(s[0, 1] ** 2 / (s[0, 0] * s[1, 1])))] if n > 1 and s[0, 0] > 0 and s[1, 1] > 0 else []

    return Grouped(lambda: (0, np.zeros(2), np.zeros((2, 2))), add, merge, finish)


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
      round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem GROUP BY 1, 2"""
)
def group_function(t: Tables):
    """A user's function of each group's rows; few groups with many rows each, spread over all tasks."""
    out = apply_grouped(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"], _line("l_extendedprice", "l_quantity"), "n long, slope double, r2 double")
    return rounded(out, 6, r2=9)


@query(
    "WITH dd AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem), "
    + ols2_sql("dd", "y", "x1", "x2", by="l_returnflag").replace("dd AS (SELECT l_returnflag, y AS y", "d2 AS (SELECT l_returnflag, y AS y").replace("FROM dd GROUP BY", "FROM d2 GROUP BY")
    + " SELECT l_returnflag, replace(replace(term, 'x1', 'l_quantity'), 'x2', 'l_discount') AS term, round(estimate, 5) AS estimate, round(std_error, 5) AS std_error, n AS nobs FROM res"
)
def grouped_by_triangle(t: Tables):
    """Regressions of groups from one triangle per group."""
    out = linear.grouped_by_triangle(t.lineitem, ["l_returnflag"], "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(out.select("l_returnflag", "term", "estimate", "std_error", "nobs"), 5)


# Mixtures --------------------------------------------------------------------------------------

_ROUNDS = 12
_EM = f"""f0 AS (SELECT cust, avg({Y}) AS a, avg(ln({X1})) AS b FROM mp GROUP BY 1),
f AS (SELECT cust, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS z1, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS z2 FROM f0 WHERE a IS NOT NULL AND b IS NOT NULL),
em(i, fam, k, c, w, m1, m2, v1, v2) AS (
  SELECT 0, fam, k, c, 1.0::DOUBLE / k, 1.5::DOUBLE * ((2*c + 1.0::DOUBLE)/k - 1), 1.5::DOUBLE * ((2*c + 1.0::DOUBLE)/k - 1), 1::DOUBLE, 1::DOUBLE
  FROM (VALUES ('EII'), ('VII'), ('EEI'), ('VVI')) g(fam), range(1, 4) h(k), range(0, 3) q(c) WHERE c < k
  UNION ALL
  SELECT i + 1, fam, k, c, nk / sum(nk) OVER m, m1, m2,
    CASE fam WHEN 'EII' THEN (sum(nk*s1) OVER m + sum(nk*s2) OVER m) / (2 * sum(nk) OVER m) WHEN 'VII' THEN (s1 + s2)/2 WHEN 'EEI' THEN sum(nk*s1) OVER m / sum(nk) OVER m ELSE s1 END,
    CASE fam WHEN 'EII' THEN (sum(nk*s1) OVER m + sum(nk*s2) OVER m) / (2 * sum(nk) OVER m) WHEN 'VII' THEN (s1 + s2)/2 WHEN 'EEI' THEN sum(nk*s2) OVER m / sum(nk) OVER m ELSE s2 END
  FROM (SELECT i, fam, k, c, sum(r) AS nk, sum(r*z1)/sum(r) AS m1, sum(r*z2)/sum(r) AS m2, sum(r*z1*z1)/sum(r) - (sum(r*z1)/sum(r))*(sum(r*z1)/sum(r)) AS s1,
      sum(r*z2*z2)/sum(r) - (sum(r*z2)/sum(r))*(sum(r*z2)/sum(r)) AS s2
    FROM (SELECT *, e / sum(e) OVER (PARTITION BY fam, k, cust) AS r
      FROM (SELECT i, fam, k, c, cust, z1, z2, w * exp(-((z1 - m1)*(z1 - m1)/v1 + (z2 - m2)*(z2 - m2)/v2)/2) / (2*pi()*sqrt(v1*v2)) AS e FROM em, f WHERE i < {_ROUNDS}))
    GROUP BY i, fam, k, c) WINDOW m AS (PARTITION BY fam, k)),
li AS (SELECT fam, k, sum(ln(p)) AS l, count(*) AS n FROM (SELECT fam, k, cust, sum(w * exp(-((z1 - m1)*(z1 - m1)/v1 + (z2 - m2)*(z2 - m2)/v2)/2) / (2*pi()*sqrt(v1*v2))) AS p
    FROM em, f WHERE i = {_ROUNDS} GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(
    f"""WITH RECURSIVE {MEMBERS}, {_EM}
      SELECT CAST(k AS INTEGER) AS classes, fam AS family, round(l, 4) AS likelihood,
        round(-2*l + (k - 1 + 2*k + CASE fam WHEN 'EII' THEN 1 WHEN 'VII' THEN k WHEN 'EEI' THEN 2 ELSE 2*k END) * ln(n), 4) AS bic FROM li"""
)
def mixture_bic(t: Tables):
    """Customers by mixtures of four covariance families and up to three classes, all fitted in the same passes."""
    p = member_panel(t).groupBy(MEMBER).agg(F.avg(Y).alias("a"), F.avg(F.log(X1)).alias("b"))
    classed, models = fit_families(p, ["a", "b"], (1, 2, 3), ("EII", "VII", "EEI", "VVI"), tol=0.0, max_iter=_ROUNDS)
    n = classed.count()
    rows = [(m.k, m.family, m.likelihood, m.bic(n)) for m in models]
    return rounded(t.spark.createDataFrame(rows, "classes int, family string, likelihood double, bic double"), 4)
