"""Difference and system GMM in SQL, for any lags, instruments and steps.

Matrices are long relations (i, j, v). A symmetric one is inverted by sweeping its scaled form pivot by pivot in a
recursive query; pivots that earlier ones explain are passed over, which gives a generalised inverse.
"""

from __future__ import annotations

from collections.abc import Sequence

Term = str | tuple[str, int]


def _term(t: Term) -> tuple[str, int]:
    return (t, 0) if isinstance(t, str) else t


def inverse(source: str, name: str) -> str:
    """CTE ``name`` (i, j, v): generalised inverse of the symmetric relation ``source`` (i, j, v)."""
    return f"""{name}_d AS (SELECT i, sqrt(v) AS d FROM {source} WHERE i = j AND v > 0),
{name}_n AS (SELECT i, d, row_number() OVER (ORDER BY i) AS r FROM {name}_d),
{name}_s(k, r, c, v) AS (
  SELECT 0::BIGINT, a.r, b.r, coalesce(s.v, 0) / (a.d * b.d) FROM {name}_n a CROSS JOIN {name}_n b LEFT JOIN {source} s ON s.i = a.i AND s.j = b.i
  UNION ALL
  SELECT k + 1, r, c, CASE WHEN p <= 1e-10 THEN v WHEN r = k + 1 AND c = k + 1 THEN -1 / p WHEN r = k + 1 OR c = k + 1 THEN v / p ELSE v - f * g / p END
  FROM (SELECT k, r, c, v, max(CASE WHEN r = k + 1 AND c = k + 1 THEN v END) OVER () AS p,
      max(CASE WHEN c = k + 1 THEN v END) OVER (PARTITION BY r) AS f, max(CASE WHEN r = k + 1 THEN v END) OVER (PARTITION BY c) AS g
    FROM {name}_s WHERE k < (SELECT count(*) FROM {name}_n))),
{name}_e AS MATERIALIZED (SELECT r, c, v FROM {name}_s WHERE k = (SELECT count(*) FROM {name}_n)),
{name}_u AS (SELECT r FROM {name}_e WHERE r = c AND v < 0),
{name} AS MATERIALIZED (SELECT a.i AS i, b.i AS j, -e.v / (a.d * b.d) AS v FROM {name}_e e JOIN {name}_n a ON a.r = e.r JOIN {name}_n b ON b.r = e.c
  WHERE e.r IN (FROM {name}_u) AND e.c IN (FROM {name}_u))"""


def _tail(x: str, density: str, steps: int = 2000) -> str:
    """One minus the integral of a density over 0 .. x in the variable t, by Simpson's rule."""
    return (
        f"(SELECT 1 - sum(CASE WHEN n = 0 OR n = {steps} THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END * f) * any_value(h) / 3"
        f" FROM (SELECT n, h, {density} AS f FROM (SELECT n, {x} / {steps} AS h, n * {x} / {steps} AS t FROM range(0, {steps + 1}) r(n))))"
    )


def normal_two_sided(z: str) -> str:
    return _tail(f"least(abs({z}), 12)", "2 / sqrt(2 * pi()) * exp(-t * t / 2)")


def chi2_upper(x: str, df: str) -> str:
    """Upper tail; the variable is the square root, in which the density is smooth."""
    return _tail(f"least(sqrt({x}), 12)", f"2 * CASE WHEN t = 0 AND {df} = 1 THEN 1 WHEN t = 0 THEN 0 ELSE pow(t, {df} - 1) END * exp(-t * t / 2 - lgamma({df} / 2.0) - {df} / 2.0 * ln(2))")


def gmm_ctes(
    y: str,
    x: Sequence[Term],
    lags: tuple[int, int],
    instruments: Sequence[Term] | None = None,
    system: bool = False,
    steps: int = 2,
    collapse: bool = True,
    twoways: bool = False,
    periods: Sequence[int] = range(1995, 2002),
) -> str:
    """CTEs over ``mp`` (cust, year, ...) up to ``est`` (c, estimate), ``vc`` (i, j, v), ``moment`` and ``w2``; regressor c = 1 is the lag."""
    a, b = lags[0], min(lags[1], len(periods) - 1)
    first = periods[0]
    regs, ivs = [(y, 1), *map(_term, x)], list(map(_term, x if instruments is None else instruments))
    need = {(y, k) for k in range(max(a, b, 2) + 1)} | {(n, k + d) for n, k in [*regs, *ivs] for d in (0, 1)}
    v = lambda n, k: f"v_{n}_{k}"
    window = lambda k: f"(PARTITION BY cust ORDER BY year RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"
    cols = ", ".join((f"{n}" if k == 0 else f"first({n}) OVER {window(k)}") + f" AS {v(n, k)}" for n, k in sorted(need))
    change = lambda n, k: f"({v(n, k)} - {v(n, k + 1)})"
    level = lambda n, k: v(n, k)
    known = lambda of: " AND ".join(f"{of(n, k)} IS NOT NULL" for n, k in [(y, 0), *regs, *ivs])
    equations = [("d", change), *([("l", level)] if system else [])]
    out = [f"gl AS MATERIALIZED (SELECT cust, year, {cols} FROM mp)"]
    out += [f"eq_{e} AS (SELECT * FROM gl WHERE {known(of)})" for e, of in equations]

    zs, xs = [], []
    z = lambda e, j, value, where="TRUE": zs.append(f"SELECT cust, year, '{e}' AS e, {j} AS j, {value} AS v FROM eq_{e} WHERE {value} IS NOT NULL AND {where}")
    for k in range(a, b + 1):
        z("d", f"'g{k:02}'" if collapse else f"'g{k:02}_' || year", v(y, k))
    if system:
        z("l", "'s'" if collapse else "'s_' || year", f"({v(y, a - 1)} - {v(y, a)})", "TRUE" if collapse else f"year >= {first + a}")
    dummies = [p for p in periods if p >= first + (1 if system else 2)] if twoways else []
    for e, of in equations:
        for i, (n, k) in enumerate(ivs):
            z(e, f"'o{i}'", of(n, k))
        for c, (n, k) in enumerate([(y, 0), *regs]):
            xs.append(f"SELECT cust, year, '{e}' AS e, {c} AS c, {of(n, k)} AS v FROM eq_{e}")
        for i, p in enumerate(dummies):
            value = f"((year = {p})::INT - (year - 1 = {p})::INT)" if e == "d" and system else f"(year = {p})::INT"
            z(e, f"'p{p}'", f"{value}::DOUBLE", f"{value} <> 0")
            xs.append(f"SELECT cust, year, '{e}' AS e, {1 + len(regs) + i} AS c, {value}::DOUBLE AS v FROM eq_{e}")
    out.append("z AS MATERIALIZED (" + " UNION ALL ".join(zs) + ")")
    out.append("xx AS MATERIALIZED (" + " UNION ALL ".join(xs) + ")")
    # Sum over periods of what an instrument has now, less what it has next.
    lead = "SELECT cust, year, j, v FROM z UNION ALL SELECT cust, year - 1, j, -v FROM z WHERE e = 'd'"
    out.append(f"q AS MATERIALIZED (SELECT cust, year, j, sum(v) AS v FROM ({lead}) GROUP BY ALL)")
    out.append("h1 AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM q a JOIN q b USING (cust, year) GROUP BY 1, 2)")
    out.append(inverse("h1", "w1"))
    out.append("zx AS MATERIALIZED (SELECT z.j AS j, c, sum(z.v * xx.v) AS v FROM z JOIN xx USING (cust, year, e) GROUP BY 1, 2)")

    def step(n: int) -> None:
        out.append(f"wz{n} AS MATERIALIZED (SELECT w.i AS j, c, sum(w.v * zx.v) AS v FROM w{n} w JOIN zx ON zx.j = w.j GROUP BY 1, 2)")
        out.append(f"m{n} AS (SELECT a.c AS i, b.c AS j, sum(a.v * b.v) AS v FROM zx a JOIN wz{n} b USING (j) WHERE a.c > 0 AND b.c > 0 GROUP BY 1, 2)")
        out.append(inverse(f"m{n}", f"a{n}"))
        out.append(f"k{n} AS MATERIALIZED (SELECT a.i AS c, wz.j AS j, sum(a.v * wz.v) AS v FROM a{n} a JOIN wz{n} wz ON wz.c = a.j GROUP BY 1, 2)")
        out.append(f"b{n} AS MATERIALIZED (SELECT k.c AS c, sum(k.v * zx.v) AS v FROM k{n} k JOIN zx USING (j) WHERE zx.c = 0 GROUP BY 1)")

    step(1)
    out.append("u1 AS MATERIALIZED (SELECT cust, year, e, sum(CASE WHEN xx.c = 0 THEN xx.v ELSE -xx.v * b1.v END) AS v FROM xx LEFT JOIN b1 ON b1.c = xx.c GROUP BY 1, 2, 3)")
    out.append("s1 AS MATERIALIZED (SELECT cust, j, sum(z.v * u1.v) AS v FROM z JOIN u1 USING (cust, year, e) GROUP BY 1, 2)")
    out.append("om AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM s1 a JOIN s1 b USING (cust) GROUP BY 1, 2)")
    out.append("v1 AS MATERIALIZED (SELECT a.c AS i, b.c AS j, sum(a.v * om.v * b.v) AS v FROM k1 a JOIN om ON om.i = a.j JOIN k1 b ON b.j = om.j GROUP BY 1, 2)")
    out.append(inverse("om", "w2"))
    if steps == 2:
        step(2)
    n = steps
    out.append(f"est AS (SELECT c, v AS estimate FROM b{n})")
    out.append(f"moment AS MATERIALIZED (SELECT j, sum(CASE WHEN zx.c = 0 THEN zx.v ELSE -zx.v * b.v END) AS v FROM zx LEFT JOIN b{n} b ON b.c = zx.c GROUP BY 1)")
    if steps == 1:
        out.append("vc AS MATERIALIZED (FROM v1)")
    else:
        # The derivative of the second weight with respect to the first estimates (Windmeijer).
        out.append("wm AS MATERIALIZED (SELECT w.i AS j, sum(w.v * m.v) AS v FROM w2 w JOIN moment m ON m.j = w.j GROUP BY 1)")
        out.append("xs AS MATERIALIZED (SELECT cust, c, z.j AS j, sum(z.v * xx.v) AS v FROM z JOIN xx USING (cust, year, e) WHERE c > 0 GROUP BY 1, 2, 3)")
        out.append("sm AS (SELECT cust, sum(s1.v * wm.v) AS v FROM s1 JOIN wm USING (j) GROUP BY 1)")
        out.append("xm AS (SELECT cust, c, sum(xs.v * wm.v) AS v FROM xs JOIN wm USING (j) GROUP BY 1, 2)")
        both = "SELECT c, j, s1.v * xm.v AS v FROM s1 JOIN xm USING (cust) UNION ALL SELECT c, j, xs.v * sm.v FROM xs JOIN sm USING (cust)"
        out.append(f"sl AS (SELECT c, j, sum(v) AS v FROM ({both}) GROUP BY 1, 2)")
        out.append("dd AS MATERIALIZED (SELECT k.c AS i, sl.c AS j, sum(k.v * sl.v) AS v FROM k2 k JOIN sl USING (j) GROUP BY 1, 2)")
        out.append("da AS (SELECT d.i AS i, a.j AS j, sum(d.v * a.v) AS v FROM dd d JOIN a2 a ON a.i = d.j GROUP BY 1, 2)")
        out.append("dv AS (SELECT d.i AS i, f.i AS j, sum(d.v * v.v * f.v) AS v FROM dd d JOIN v1 v ON v.i = d.j JOIN dd f ON f.j = v.j GROUP BY 1, 2)")
        parts = "SELECT i, j, v FROM a2 UNION ALL SELECT i, j, v FROM da UNION ALL SELECT j, i, v FROM da UNION ALL SELECT i, j, v FROM dv"
        out.append(f"vc AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM ({parts}) GROUP BY 1, 2)")
    names = [f"lag({y},1)", *(n if k == 0 else f"lag({n},{k})" for n, k in regs[1:]), *(f"period_{p}" for p in dummies)]
    out.append("nm(c, term) AS (VALUES " + ", ".join(f"({i + 1}, '{t}')" for i, t in enumerate(names)) + ")")
    return ", ".join(out)


RESULT = "SELECT term, round(estimate, 8) AS estimate, round(sqrt(vc.v), 8) AS std_error FROM est JOIN nm USING (c) JOIN vc ON vc.i = c AND vc.j = c"


def test_rows(k: int, steps: int = 2) -> str:
    """Selects of the specification tests of a fit with ``k`` regressors and no period dummies."""
    ctes = [
        f"uf AS MATERIALIZED (SELECT cust, year, e, sum(CASE WHEN xx.c = 0 THEN xx.v ELSE -xx.v * b.v END) AS v FROM xx LEFT JOIN b{steps} b ON b.c = xx.c GROUP BY 1, 2, 3)",
        "sf AS (SELECT cust, j, sum(z.v * uf.v) AS v FROM z JOIN uf USING (cust, year, e) GROUP BY 1, 2)",
        "sg AS (SELECT sum(a.v * w.v * b.v) AS x, (SELECT count(DISTINCT j) FROM z) - " + f"{k} AS df FROM moment a JOIN w2 w ON w.i = a.j JOIN moment b ON b.j = w.j)",
        inverse("vc", "vi"),
        "wd AS (SELECT sum(a.estimate * i.v * b.estimate) AS x FROM est a JOIN vi i ON i.i = a.c JOIN est b ON b.c = i.j)",
    ]
    rows = [
        f"SELECT 'sargan' AS test, round(x, 3) AS statistic, df::DOUBLE AS df, round({chi2_upper('x', 'df')}, 6) AS p_value FROM sg",
        f"SELECT 'wald_coefficients', round(x, 3), {k}::DOUBLE, abs(round({chi2_upper('x', str(k))}, 6)) FROM wd",
    ]
    for o in (1, 2):
        ctes += [
            f"lw{o} AS (SELECT a.cust AS cust, a.year AS year, a.v * b.v AS we, b.v AS w FROM uf a JOIN uf b ON b.cust = a.cust AND b.year = a.year - {o} AND b.e = 'd' WHERE a.e = 'd')",
            f"lc{o} AS (SELECT cust, sum(we) AS v FROM lw{o} GROUP BY 1)",
            f"la{o} AS (SELECT c, sum(w * xx.v) AS v FROM lw{o} JOIN xx USING (cust, year) WHERE xx.e = 'd' AND c > 0 GROUP BY 1)",
            f"lz{o} AS (SELECT j, sum(lc.v * sf.v) AS v FROM lc{o} lc JOIN sf USING (cust) GROUP BY 1)",
            f"lg{o} AS (SELECT k.c AS c, sum(k.v * lz.v) AS v FROM k{steps} k JOIN lz{o} lz USING (j) GROUP BY 1)",
            f"""lt{o} AS (SELECT (SELECT sum(v) FROM lc{o}) / sqrt((SELECT sum(v * v) FROM lc{o}) - 2 * (SELECT sum(a.v * g.v) FROM la{o} a JOIN lg{o} g USING (c))
                + (SELECT sum(a.v * vc.v * b.v) FROM la{o} a JOIN vc ON vc.i = a.c JOIN la{o} b ON b.c = vc.j)) AS x)""",
        ]
        rows.append(f"SELECT 'ar{o}', round(x, 3), NULL, abs(round({normal_two_sided('x')}, 6)) FROM lt{o}")
    return ", ".join(ctes) + " " + " UNION ALL ".join(rows)
