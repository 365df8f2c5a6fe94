"""Query registry and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.trade_panel import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(tables)`` under its name, with the SQL that must give the same rows."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, special.get(f.name, digits)).alias(f.name)
        out.append(c)
    return df.select(*out)


# SQL pieces --------------------------------------------------------------------------------------

LINES = """lines AS (
  SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS year, l.*
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""

_SHARES = """comp / nullif(gdp, 0) AS labor_share,
    comp / nullif(gdp - (personal_inc - comp), 0) AS payroll_share,
    est / nullif(empl, 0) AS est_per_worker,
    (n1_4*16.0 + n5_9*81.0 + n10_19*361.0 + n20_49*2401.0 + n50*2500.0) / nullif(empl*empl, 0) AS hhi_labor"""

MEMBERS = (
    LINES
    + """, mp0 AS (
  SELECT cust, year, sum(l_extendedprice) AS gdp,
    sum(l_extendedprice*(1-l_discount)) AS comp,
    sum(l_extendedprice*(1-l_discount)*(1+l_tax)) AS personal_inc,
    sum(l_quantity) AS empl, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS est,
    avg(l_discount) AS union_memb, avg(l_tax) AS unempl_rate,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) AS import_exposure,
    CAST(count(*) FILTER (l_quantity BETWEEN 1 AND 4) AS DOUBLE) AS n1_4,
    CAST(count(*) FILTER (l_quantity BETWEEN 5 AND 9) AS DOUBLE) AS n5_9,
    CAST(count(*) FILTER (l_quantity BETWEEN 10 AND 19) AS DOUBLE) AS n10_19,
    CAST(count(*) FILTER (l_quantity BETWEEN 20 AND 49) AS DOUBLE) AS n20_49,
    CAST(count(*) FILTER (l_quantity BETWEEN 50 AND 50) AS DOUBLE) AS n50
  FROM lines GROUP BY 1, 2),
mp AS (SELECT *, """
    + _SHARES
    + " FROM mp0)"
)

_ROLL = ", ".join(f"sum({c}) AS {c}" for c in "gdp comp personal_inc empl est n1_4 n5_9 n10_19 n20_49 n50".split())

CAPITAL = """, kc AS (
  SELECT c_mktsegment AS sector, year, sum(l_extendedprice) / sum(l_quantity * p_retailprice) AS capital_cost_index
  FROM lines JOIN customer ON cust = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

_CASE = """CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 'AUTO-MACH'
    WHEN c_mktsegment IN ('BUILDING','FURNITURE') THEN 'BUILD-FURN' ELSE c_mktsegment END"""


def zones_sql(merged: bool = False) -> str:
    """CTE list ending in zp: the zone panel with capital cost and derived measures."""
    second = _CASE.replace("c_mktsegment", "sector") if merged else "sector"
    means = ", ".join(f"avg({c}) AS {c}" for c in ("union_memb", "unempl_rate", "import_exposure", "capital_cost_index"))
    return (
        MEMBERS
        + CAPITAL
        + f""", z1 AS (
  SELECT c_nationkey AS zone, c_mktsegment AS sector, mp.year, {_ROLL}, {means}
  FROM mp JOIN customer ON cust = c_custkey
  LEFT JOIN kc ON kc.sector = c_mktsegment AND kc.year = mp.year GROUP BY 1, 2, 3),
z2 AS (SELECT zone, {second} AS sector, year, {_ROLL}, {means} FROM z1 GROUP BY 1, 2, 3),
zp AS (SELECT *, {_SHARES},
    empl / nullif(sum(empl) OVER (PARTITION BY zone, year), 0) AS empl_share,
    gdp / nullif(sum(gdp) OVER (PARTITION BY zone, year), 0) AS va_share FROM z2)"""
    )


def ols2_sql(source: str, y: str, x1: str, x2: str, by: str | None = None, robust: bool = False, lost: str = "3",
             intercept: bool = True) -> str:
    """CTEs m, fit, res ending in rows (term, estimate, std_error) of a two-regressor regression on
    CTE ``source``; closed form of the 2 x 2 normal equations on centred moments."""
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN fit USING ({by})" if by else "CROSS JOIN fit"
    ok = f"{y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL"
    cte = f"""dd AS (SELECT {g}{y} AS y, {x1} AS x1, {x2} AS x2 FROM {source} WHERE {ok}),
m AS (SELECT {g}count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2,
  regr_sxx(y, x1) AS s11, regr_sxx(y, x2) AS s22, regr_sxy(x1, x2) AS s12,
  regr_sxy(y, x1) AS s1y, regr_sxy(y, x2) AS s2y, regr_syy(y, x1) AS syy FROM dd {grp}),
fit AS (SELECT *, s11*s22 - s12*s12 AS det, (s22*s1y - s12*s2y) / det AS b1, (s11*s2y - s12*s1y) / det AS b2,
  my - b1*m1 - b2*m2 AS b0, syy - b1*s1y - b2*s2y AS rss, rss / (n - {lost}) AS s2,
  s22/det AS i11, s11/det AS i22, -s12/det AS i12 FROM m)"""
    if not robust:
        se0 = "sqrt(s2 * (1.0/n + m1*m1*i11 + 2*m1*m2*i12 + m2*m2*i22))"
        se1, se2, src = "sqrt(s2*i11)", "sqrt(s2*i22)", "fit"
        extra = ""
    else:
        # Sandwich on centred regressors, mapped to the intercept at zero.
        extra = f""", meat AS (SELECT {g}sum(e*e) AS g00, sum(e*e*c1) AS g01, sum(e*e*c2) AS g02,
  sum(e*e*c1*c1) AS g11, sum(e*e*c1*c2) AS g12, sum(e*e*c2*c2) AS g22
  FROM (SELECT dd.*, y - b0 - b1*x1 - b2*x2 AS e, x1 - m1 AS c1, x2 - m2 AS c2 FROM dd {join}) {grp}),
rob AS (SELECT *, n / (n - 3.0) AS sc,
  i11*i11*g11 + 2*i11*i12*g12 + i12*i12*g22 AS v11, i12*i12*g11 + 2*i12*i22*g12 + i22*i22*g22 AS v22,
  i11*i12*g11 + (i11*i22 + i12*i12)*g12 + i12*i22*g22 AS v12,
  (i11*g01 + i12*g02)/n AS v01, (i12*g01 + i22*g02)/n AS v02, g00/(n*n) AS v00
  FROM fit {'JOIN meat USING (' + by + ')' if by else 'CROSS JOIN meat'})"""
        se0 = "sqrt(sc*(v00 + m1*m1*v11 + m2*m2*v22 + 2*m1*m2*v12 - 2*m1*v01 - 2*m2*v02))"
        se1, se2, src = "sqrt(sc*v11)", "sqrt(sc*v22)", "rob"
    parts = []
    if intercept:
        parts.append(f"SELECT {g}'(Intercept)' AS term, b0 AS estimate, {se0} AS std_error, n FROM {src}")
    parts.append(f"SELECT {g}'{x1}' AS term, b1 AS estimate, {se1} AS std_error, n FROM {src}")
    parts.append(f"SELECT {g}'{x2}' AS term, b2 AS estimate, {se2} AS std_error, n FROM {src}")
    return cte + extra + ", res AS (" + " UNION ALL ".join(parts) + ")"
