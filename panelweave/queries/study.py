"""The models at the size the study uses them: four regressors, exogenous ones beside instruments.

Their SQL sweeps the centred cross-product matrix, one pivot for each common table expression, so it
holds for any number of regressors.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..models import diagnostics, iv as ivm, linear, panel_models as pm, report
from ..models.diagnostics import ADF_LOWER, ADF_MAX, ADF_MIN, ADF_SWITCH, ADF_UPPER
from ..operators.panel import CALENDAR, Panel
from ..plans.regional_panel import YEAR
from ..plans.trade_panel import MEMBER, Tables, member_panel
from .estimators import RESULT, Y, calendar_differences, coefficients, customers, demeaned
from .inference import statistics
from .registry import MEMBERS, query, rounded

CONTROLS = ["HHI_labor", "unempl_rate", "union_memb", "import_exposure"]


def _at(i: int, j: int) -> str:
    return f"a_{min(i, j)}_{max(i, j)}"


def products(name: str, source: str, columns: Sequence[str]) -> str:
    """CTE ``name``: n, means m_i and centred cross-products a_i_j over rows without NULL."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    means = ", ".join(f"avg({c}) AS m_{i}" for i, c in enumerate(columns))
    cells = ", ".join(f"regr_sxy({columns[j]}, {columns[i]}) AS {_at(i, j)}" for i in range(len(columns)) for j in range(i, len(columns)))
    return f"{name} AS (SELECT count(*) AS n, {means}, {cells} FROM {source} WHERE {known})"


def sweep(start: str, size: int, pivots: Sequence[int], name: str) -> str:
    """CTEs from ``start`` to ``name`` that sweep the symmetric matrix on the pivots.

    Afterwards the pivot block is minus the inverse, the rest of its rows the coefficients, and the
    remaining block what the pivots leave unexplained.
    """
    out, last = [], start
    for step, k in enumerate(pivots):
        d, cells = _at(k, k), []
        for i in range(size):
            for j in range(i, size):
                old = _at(i, j)
                if i == j == k:
                    new = f"-1.0 / {d}"
                elif k in (i, j):
                    new = f"{old} / {d}"
                else:
                    new = f"{old} - {_at(i, k)} * {_at(k, j)} / {d}"
                cells.append(f"{new} AS {old}")
        here = name if step == len(pivots) - 1 else f"{name}_{step}"
        out.append(f"{here} AS (SELECT * EXCLUDE ({', '.join(_at(i, j) for i in range(size) for j in range(i, size))}), {', '.join(cells)} FROM {last})")
        last = here
    return ", ".join(out)


def _result(swept: str, columns: Sequence[str], s2: str, intercept: bool) -> str:
    """CTE res: a row per term. Column 0 is the outcome, ``swept`` is swept on all others."""
    k = range(1, len(columns))
    parts = [f"SELECT '{columns[i]}' AS term, {_at(0, i)} AS estimate, sqrt({s2} * -{_at(i, i)}) AS std_error FROM {swept}" for i in k]
    if intercept:
        b0 = "m_0" + "".join(f" - {_at(0, i)} * m_{i}" for i in k)
        spread = "".join(f" - m_{i} * m_{j} * {_at(i, j)}" for i in k for j in k)
        parts.append(f"SELECT '(Intercept)', {b0}, sqrt({s2} * (1.0 / n{spread})) FROM {swept}")
    return "res AS (" + " UNION ALL ".join(parts) + ")"


def regression(source: str, columns: Sequence[str], lost: str | None = None, intercept: bool = True) -> str:
    """CTEs of a least-squares fit of the first column on the others; ``lost`` degrees of freedom in SQL."""
    p = len(columns)
    used = lost or str(p)
    return ", ".join(
        [products("cp", source, columns), sweep("cp", p, range(1, p), "sw"), _result("sw", columns, f"a_0_0 / (n - {used})", intercept)]
    )


_ALL = [Y, *CONTROLS]


@query(f"WITH {MEMBERS}, {regression('mp', _ALL)} {RESULT}")
def ols_study(t: Tables):
    """Pooled least squares with four regressors."""
    return coefficients(t, linear.ols(member_panel(t), Y, CONTROLS))


@query(f"WITH {MEMBERS}, {calendar_differences(*_ALL)}, {regression('fd', _ALL)} {RESULT}")
def fd_study(t: Tables):
    """First differences with four regressors."""
    return coefficients(t, pm.first_difference(Panel(member_panel(t), MEMBER, YEAR), Y, CONTROLS, CALENDAR))


_WITHIN = regression("wd", _ALL, lost="(SELECT count(DISTINCT cust) + 4 FROM mp)", intercept=False)


@query(f"WITH {MEMBERS}, {demeaned(*_ALL)}, {_WITHIN} {RESULT}")
def within_study(t: Tables):
    """One-way fixed effects with four regressors."""
    return coefficients(t, pm.within(customers(t, *_ALL), Y, CONTROLS).fit)


def two_stage(source: str, y: str, endog: Sequence[str], exog: Sequence[str], instruments: Sequence[str]) -> str:
    """CTEs of two-stage least squares: sweep on the instruments, then on the projected regressors."""
    columns = [y, *exog, *endog, *instruments]
    p, k = len(columns), 1 + len(exog) + len(endog)
    z = [*range(1, 1 + len(exog)), *range(k, p)]
    projected = {*range(1 + len(exog), k), 0}
    cells = []
    for i in range(k):
        for j in range(i, k):
            # What the instruments explain; exogenous regressors explain themselves.
            both = i in projected and j in projected
            cells.append(f"c.{_at(i, j)}{f' - f.{_at(i, j)}' if both else ''} AS {_at(i, j)}")
    kept = ", ".join(["c.n", *[f"c.m_{i}" for i in range(k)], *[f"c.{_at(i, j)} AS x{_at(i, j)[1:]}" for i in range(k) for j in range(i, k)]])
    rss = "x_0_0" + "".join(f" - 2 * {_at(0, i)} * x{_at(0, i)[1:]}" for i in range(1, k))
    rss += "".join(f" + {_at(0, i)} * {_at(0, j)} * x{_at(i, j)[1:]}" for i in range(1, k) for j in range(1, k))
    return ", ".join(
        [
            products("cp", source, columns),
            sweep("cp", p, z, "first"),
            f"pr AS (SELECT {kept}, {', '.join(cells)} FROM cp c CROSS JOIN first f)",
            sweep("pr", k, range(1, k), "sw"),
            _result("sw", columns[:k], f"({rss}) / (n - {k})", True),
        ]
    )


_EXOG, _ENDOG, _INSTRUMENTS = ["unempl_rate", "union_memb"], ["HHI_labor"], ["est_per_worker", "import_exposure"]


@query(f"WITH {MEMBERS}, {two_stage('mp', Y, _ENDOG, _EXOG, _INSTRUMENTS)} {RESULT}")
def iv_study(t: Tables):
    """Two-stage least squares with exogenous regressors."""
    return coefficients(t, ivm.iv(member_panel(t), Y, _ENDOG, _EXOG, _INSTRUMENTS))


@query(f"WITH {MEMBERS}, {calendar_differences(Y, *_ENDOG, *_EXOG, *_INSTRUMENTS)}, {two_stage('fd', Y, _ENDOG, _EXOG, _INSTRUMENTS)} {RESULT}")
def iv_fd_study(t: Tables):
    """The same on first differences."""
    p = Panel(member_panel(t), MEMBER, YEAR)
    columns = [Y, *_ENDOG, *_EXOG, *_INSTRUMENTS]
    return coefficients(t, ivm.iv(pm.differenced(p, columns, CALENDAR), Y, _ENDOG, _EXOG, _INSTRUMENTS))


_FOOTER = f"""cp0 AS (SELECT a_0_0 AS tss FROM cp)
  SELECT 'ols' AS model, u.statistic, round(u.value, 6) AS value FROM (
    SELECT n, a_0_0 AS rss, tss, n - {len(_ALL)} AS df FROM sw CROSS JOIN cp0
  ) CROSS JOIN LATERAL (VALUES ('nobs', CAST(n AS DOUBLE)), ('r2', 1 - rss / tss),
    ('f', ((tss - rss) / {len(CONTROLS)}) / (rss / df)), ('df', CAST(df AS DOUBLE))) u(statistic, value)"""


@query(f"WITH {MEMBERS}, {regression('mp', _ALL)}, {_FOOTER}")
def model_footer(t: Tables):
    """Observations, R squared, F and its degrees of freedom, as they stand under a table of models."""
    fit = linear.ols(member_panel(t), Y, CONTROLS)
    short = {"nobs": "nobs", "r_squared": "r2", "f_statistic": "f", "df_resid": "df"}
    rows = [(m, short[k], v) for m, k, v in report.summary_rows([("ols", fit)]) if k in short]
    return rounded(t.spark.createDataFrame(rows, "model string, statistic string, value double"))


def _surface(c: Sequence[float]) -> str:
    return " + ".join(f"({v!r}) * s" + "*s" * (i - 1) if i else f"({v!r})" for i, v in enumerate(c))


_DICKEY = f"""l AS (SELECT cust, {Y} - lag({Y}) OVER c AS dy, lag({Y}) OVER c AS y1 FROM mp WINDOW c AS (PARTITION BY cust ORDER BY year)),
  s AS (SELECT cust, count(*) AS n, regr_sxx(dy, y1) AS sxx, regr_sxy(dy, y1) AS sxy, regr_syy(dy, y1) AS syy FROM l WHERE dy IS NOT NULL GROUP BY 1 HAVING count(*) > 2),
  r AS (SELECT cust, sxy/sxx / sqrt((syy - sxy*sxy/sxx)/(n - 2)/sxx) AS t FROM s WHERE sxx > 0 AND syy - sxy*sxy/sxx > 1e-12*syy)"""


def _chosen_lags(orders: Sequence[int]) -> str:
    """CTE r: the statistic of the lag order with the least Schwarz criterion per observation."""
    lags = ", ".join(f"lag(dy, {k}) OVER c AS d{k}" for k in range(1, max(orders) + 1))
    out = [
        f"l0 AS (SELECT cust, year, {Y} - lag({Y}) OVER c AS dy, lag({Y}) OVER c AS y1 FROM mp WINDOW c AS (PARTITION BY cust ORDER BY year))",
        f"l AS (SELECT *, {lags} FROM l0 WINDOW c AS (PARTITION BY cust ORDER BY year))",
    ]
    parts = []
    for p in orders:
        cols = ["dy", "y1", *[f"d{k}" for k in range(1, p + 1)]]
        size = len(cols)
        cells = ", ".join(f"regr_sxy({cols[j]}, {cols[i]}) AS {_at(i, j)}" for i in range(size) for j in range(i, size))
        solid = " AND ".join(f"{_at(i, i)} > 0" for i in range(1, size))
        apart = f" AND 1 - {_at(1, 2)} * {_at(1, 2)} / ({_at(1, 1)} * {_at(2, 2)}) > 1e-10" if p == 1 else ""
        out.append(f"c{p} AS (SELECT cust, count(*)::DOUBLE AS n, {cells}, regr_sxy(dy, dy) AS tss FROM l WHERE {cols[-1] if p else 'dy'} IS NOT NULL GROUP BY cust HAVING count(*) > {p + 2})")
        out.append(f"e{p} AS (SELECT * FROM c{p} WHERE {solid}{apart})")
        out.append(sweep(f"e{p}", size, range(1, size), f"o{p}"))
        parts.append(
            f"SELECT cust, {p} AS lags, (n * ln(a_0_0 / n) + {p + 2} * ln(n)) / n AS sic, a_0_1 / sqrt(a_0_0 / (n - {p + 2}) * -a_1_1) AS t FROM o{p} WHERE a_0_0 > 1e-12 * tss"
        )
    out.append("every AS (" + " UNION ALL ".join(parts) + ")")
    out.append("r AS (SELECT cust, t FROM every QUALIFY row_number() OVER (PARTITION BY cust ORDER BY sic, lags) = 1)")
    return ", ".join(out)


#: Normal tail by Simpson's rule from |z| on; its logarithm keeps its digits far out.
_FISHER = f"""z AS (SELECT cust, t, CASE WHEN s <= {ADF_SWITCH} THEN {_surface(ADF_LOWER)} ELSE {_surface(ADF_UPPER)} END AS z
    FROM (SELECT *, greatest(t, {ADF_MIN}) AS s FROM r)),
  tails AS (SELECT cust, t, z, sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(-0.5 * power(abs(z) + i * 0.005, 2))) * 0.005 / 3 / sqrt(2 * pi()) AS tail
    FROM z CROSS JOIN range(0, 2001) g(i) GROUP BY 1, 2, 3),
  p AS (SELECT t, CASE WHEN t > {ADF_MAX} THEN 1.0 WHEN z < 0 THEN tail ELSE 1 - tail END AS p FROM tails),
  f AS (SELECT sum(-2 * ln(p)) AS statistic, count(*) AS n, count(*) FILTER (WHERE t < {ADF_MIN}) AS beyond FROM p),
  -- Upper tail of chi-square in the square root of the variable, where the density is smooth.
  g AS (SELECT any_value(h) / 3 * sum(CASE WHEN i = 0 OR i = 8000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp((2 * n - 1) * ln(x + i * h) - (x + i * h) * (x + i * h) / 2 - lgamma(n) - (n - 1) * ln(2))) AS p_value
    FROM (SELECT n::DOUBLE AS n, sqrt(statistic) AS x, (greatest(sqrt(statistic), sqrt(2 * n)) + 8 - sqrt(statistic)) / 8000 AS h FROM f) CROSS JOIN range(0, 8001) q(i))"""


@query(
    f"""WITH {MEMBERS}, {_DICKEY}, {_FISHER}
      SELECT u.statistic, round(u.value, 4) AS value FROM f CROSS JOIN LATERAL (VALUES ('statistic', f.statistic), ('df', 2.0 * n),
        ('entities', CAST(n AS DOUBLE)), ('beyond_surface', CAST(beyond AS DOUBLE)),
        ('not_identified', CAST((SELECT count(DISTINCT cust) FROM mp) - n AS DOUBLE))) u(statistic, value)"""
)
def unit_root_fisher_dickey(t: Tables):
    """Panel unit-root test without lagged differences."""
    out = diagnostics.unit_root_fisher(Panel(member_panel(t), MEMBER, YEAR), Y, pmax=0)
    return statistics(t, [(k, float(v)) for k, v in out.items() if k != "p_value"], 4)


@query(
    f"""WITH {MEMBERS}, {_chosen_lags((0, 1, 2))}, {_FISHER}
      SELECT u.statistic, round(u.value, 4) AS value FROM f CROSS JOIN g CROSS JOIN LATERAL (VALUES ('statistic', f.statistic), ('df', 2.0 * n), ('p_value', p_value),
        ('entities', CAST(n AS DOUBLE)), ('beyond_surface', CAST(beyond AS DOUBLE)),
        ('not_identified', CAST((SELECT count(DISTINCT cust) FROM mp) - n AS DOUBLE))) u(statistic, value)"""
)
def unit_root_fisher(t: Tables):
    """Maddala-Wu panel unit-root test with lag orders up to four; seven periods identify orders up to one."""
    out = diagnostics.unit_root_fisher(Panel(member_panel(t), MEMBER, YEAR), Y)
    return statistics(t, out.items(), 4)
