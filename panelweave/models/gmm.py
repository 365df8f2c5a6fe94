"""Difference and system GMM for dynamic panels.

Rows of one entity are related only through calendar lags and through sums over the entity, so the
work is one exchange by entity: lags, differences and instruments are window columns, the moments
``Z'X``, ``Z'y`` and the first-step weight are row-level sums, and entity scores are grouped sums on
the same partitioning. Only matrices whose size is the number of instruments reach the driver.

First-step weight: for errors that are independent over time, differenced errors have covariance
D D'. With q_s = z_s - z_(s+1) for every observed period s, sum Z'DD'Z is the plain Gram matrix of
q; adding the level-equation instruments to q gives the full system weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..functions import distributions as dist
from ..operators.panel import Panel
from ..session import materialise
from .gmm_blocks import BlockSystem, Layout
from .linear import Fit
from .moments import gram, group, number
from .panel_models import INDIVIDUAL, TWOWAYS, check_effect, periods_of

Term = str | tuple[str, int]
#: Instruments up to which rows have a column for each.
DENSE_COLUMNS = 300


def _term(t: Term) -> tuple[str, int]:
    return (t, 0) if isinstance(t, str) else t


def _label(t: Term) -> str:
    name, k = _term(t)
    return name if k == 0 else f"lag({name},{k})"


def _pinv(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Pseudo-inverse of a symmetric matrix on its scaled form, and its rank."""
    d = np.sqrt(np.abs(np.diag(a)))
    d = np.where(d > 0, d, 1.0)
    s = a / np.outer(d, d)
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    inv = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    return inv / np.outer(d, d), int(keep.sum())


@dataclass
class GmmFit:
    """Estimates of both steps, their covariances and specification tests."""

    fit: Fit
    one_step: np.ndarray
    one_step_robust: np.ndarray
    vcov_classical: np.ndarray
    n_entities: int
    n_instruments: int
    weight_rank: int
    tests: list[tuple[str, float, float, float]] = field(default_factory=list)

    def test(self, name: str) -> tuple[float, float, float]:
        return next((a, b, c) for n, a, b, c in self.tests if n == name)

    def tests_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.tests, "test string, statistic double, df double, p_value double")


@dataclass
class _System:
    """Row table with stacked equations: columns d_*/l_* and instruments per equation."""

    rows: DataFrame
    panel: Panel
    terms: list[str]
    zd: list[str]
    zl: list[str]
    system: bool

    def equations(self) -> list[tuple[list[str], str, list[str]]]:
        k = len(self.terms)
        out = [(self.zd, "d_y", [f"d_{i}" for i in range(k)])]
        if self.system:
            out.append((self.zl, "l_y", [f"l_{i}" for i in range(k)]))
        return out

    def over(self, frame: str) -> str:
        entity = ", ".join(f"`{c}`" for c in self.panel.entity)
        return f"OVER (PARTITION BY {entity} ORDER BY `{self.panel.time}` RANGE BETWEEN {frame})"


def _build(
    panel: Panel,
    y: str,
    x: Sequence[Term],
    gmm_lags: tuple[int, int],
    instruments: Sequence[Term],
    system: bool,
    collapse: bool,
    effect: str,
    full: bool,
    ar_orders: Sequence[int],
    times: list[int],
    blocks: bool = False,
) -> _System | BlockSystem:
    a, b = gmm_lags
    first = times[0]
    keys = [f"`{c}`" for c in (*panel.entity, panel.time)]
    t = f"`{panel.time}`"
    s = _System(panel.df, panel, [], [], [], system)

    # 1. Calendar lags of the source columns: one exchange and one sort.
    need: dict[tuple[str, int], None] = {(y, k): None for k in range(0, max(a, b, 2) + 1)}
    for name, k in map(_term, [*x, *instruments]):
        need[(name, k)] = need[(name, k + 1)] = None
    lag = {(n, k): f"`v_{n}_{k}`" for n, k in need}

    def lagged(name: str, k: int) -> str:
        # NaN and infinite values count as missing.
        source = f"CASE WHEN abs(CAST(`{name}` AS DOUBLE)) < CAST('Infinity' AS DOUBLE) THEN CAST(`{name}` AS DOUBLE) END"
        return source if k == 0 else f"first({source}) " + s.over(f"{k} PRECEDING AND {k} PRECEDING")

    rows = panel.df.selectExpr(*keys, *[f"{lagged(n, k)} AS {c}" for (n, k), c in lag.items()])
    v = lambda n, k=0: lag[(n, k)]

    # 2. Equations. An equation exists where all its terms do.
    reg = [(y, 1), *map(_term, x)]
    s.terms = [f"lag({y},1)", *map(_label, x)]
    ivs = list(map(_term, instruments))
    dcols = {"d_y": f"{v(y)} - {v(y, 1)}"} | {f"d_{i}": f"{v(n, k)} - {v(n, k + 1)}" for i, (n, k) in enumerate(reg)}
    lcols = {"l_y": v(y)} | {f"l_{i}": v(n, k) for i, (n, k) in enumerate(reg)}
    ivd = [f"{v(n, k)} - {v(n, k + 1)}" for n, k in ivs]
    ivl = [v(n, k) for n, k in ivs]
    exists = lambda cols: " AND ".join(f"({c}) IS NOT NULL" for c in cols)
    rows = rows.selectExpr("*", f"{exists([*dcols.values(), *ivd])} AS in_d", f"{exists([*lcols.values(), *ivl])} AS in_l")

    # 3. Instruments. Missing lags count as zero.
    if blocks:
        dummies = [p for p in times if p >= first + (1 if system else 2)] if effect == TWOWAYS else []
        layout = Layout(times, (a, b), system, len(ivs), len(reg), dummies)
        listed = lambda flag, cols: f"CASE WHEN {flag} THEN CAST(array({', '.join(f'coalesce({c}, 0D)' for c in cols)}) AS array<double>) END"
        out = {"zd": listed("in_d", [v(y, k) for k in range(a, b + 1)]), "od": listed("in_d", ivd), "xd": listed("in_d", dcols.values())}
        if system:
            out |= {"zl": listed("in_l", [f"{v(y, a - 1)} - {v(y, a)}"]), "ol": listed("in_l", ivl), "xl": listed("in_l", lcols.values())}
        ahead = [f"first({c}) {s.over('1 FOLLOWING AND 1 FOLLOWING')} AS next_{c}" for c in ("zd", "od")]
        rows = rows.selectExpr(*keys, *[f"{c} AS {n}" for n, c in out.items()]).selectExpr("*", *ahead)
        made = BlockSystem(materialise(rows), panel, layout)
        made.terms = [*s.terms, *[f"period_{p}" for p in dummies]]
        return made
    where = lambda c, flag: f"CASE WHEN {flag} THEN coalesce({c}, 0D) ELSE 0D END"
    zd: list[str] = []
    zl: list[str] = []

    def instrument(d: str = "0D", l: str = "0D") -> None:
        zd.append(d)
        zl.append(l)

    if collapse:
        for k in range(a, b + 1):
            instrument(d=where(v(y, k), "in_d"))
    else:
        for p in times:
            for k in range(a, min(b, p - first) + 1):
                instrument(d=where(v(y, k), f"in_d AND {t} = {p}"))
    if system:
        step = f"{v(y, a - 1)} - {v(y, a)}"
        if collapse:
            instrument(l=where(step, "in_l"))
        else:
            for p in times:
                if p >= first + a:
                    instrument(l=where(step, f"in_l AND {t} = {p}"))
    for cd, cl in zip(ivd, ivl):
        instrument(where(cd, "in_d"), where(cl, "in_l"))

    # 4. Period effects: regressors that are their own instruments.
    if effect == TWOWAYS:
        for p in times:
            if p < first + (1 if system else 2):
                continue
            level = f"CAST({t} = {p} AS DOUBLE)"
            change = f"({level} - CAST({t} - 1 = {p} AS DOUBLE))" if system else level
            i = len(s.terms)
            dcols[f"d_{i}"], lcols[f"l_{i}"] = change, level
            instrument(where(change, "in_d"), where(level, "in_l"))
            s.terms.append(f"period_{p}")

    out = [f"CASE WHEN in_d THEN {c} END AS {n}" for n, c in dcols.items()]
    out += [f"{c} AS zd_{j}" for j, c in enumerate(zd)]
    if system:
        out += [f"CASE WHEN in_l THEN {c} END AS {n}" for n, c in lcols.items()]
        out += [f"{c} AS zl_{j}" for j, c in enumerate(zl)]
    s.zd, s.zl = [f"zd_{j}" for j in range(len(zd))], [f"zl_{j}" for j in range(len(zl))]
    rows = rows.selectExpr(*keys, *out)

    # 5. What later passes need from neighbouring periods, on the same partitioning and order: the
    # next instruments for the first weight, and earlier equations for the serial-correlation tests.
    ahead = f"first(array({', '.join(s.zd)})) {s.over('1 FOLLOWING AND 1 FOLLOWING')} AS nx"
    back = [
        f"first({c}) {s.over(f'{o} PRECEDING AND {o} PRECEDING')} AS b{o}_{c}" for o in ar_orders for c in dcols
    ]
    plus = [f" + {l}" if system and full else "" for l in s.zl]
    q = [f"{c} - coalesce(nx[{j}], 0D){plus[j]} AS q_{j}" for j, c in enumerate(s.zd)]
    rows = rows.selectExpr("*", ahead, *back).selectExpr("*", *q).drop("nx")
    s.rows = materialise(rows)
    return s


def _first_weight(s: _System, full: bool) -> np.ndarray:
    """Gram matrix of q_s (see the module text); ``full`` keeps the cross-equation covariance."""
    q = [f"q_{j}" for j in range(len(s.zd))]
    return gram(s.rows, (q, q), *([(s.zl, s.zl)] if s.system and not full else []))


def _cross(s: _System) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'X, Z'y and the number of equation rows."""
    g = gram(s.rows, *[([*z, "1D"], [y, *x, f"CAST({y} IS NOT NULL AS DOUBLE)"]) for z, y, x in s.equations()])
    return g[:-1, 1:-1], g[:-1, 0], int(round(g[-1, -1]))


def _residual(y: str, x: Sequence[str], beta: np.ndarray) -> str:
    return y + "".join(f" - {number(b)} * {c}" for c, b in zip(x, beta))


def _scores(s: _System, rows: DataFrame, beta: np.ndarray, extra: Sequence[str] = (), with_x: bool = False) -> DataFrame:
    """One row per entity: u_j = Z'u, optionally x_k_j = Z'x_k and further sums."""
    eqs = s.equations()
    rows = rows.selectExpr("*", *[f"{_residual(y, x, beta)} AS u{i}" for i, (_, y, x) in enumerate(eqs)])
    total = lambda parts: "sum(" + " + ".join(f"coalesce({z} * {c}, 0D)" for z, c in parts) + ")"
    aggs = [f"{total([(z[j], f'u{i}') for i, (z, _, _) in enumerate(eqs)])} AS u_{j}" for j in range(len(s.zd))]
    if with_x:
        for k in range(len(s.terms)):
            aggs += [f"{total([(z[j], x[k]) for z, _, x in eqs])} AS x_{k}_{j}" for j in range(len(s.zd))]
    aggs.append(" + ".join(f"count({y})" for _, y, _ in eqs) + " AS n_eq")
    return group(rows, s.panel.entity, [*aggs, *extra])


def _ar_tests(
    s: _System, orders: Sequence[int], beta: np.ndarray, gain: np.ndarray, vcov: np.ndarray
) -> list[tuple[str, float, float, float]]:
    """Arellano-Bond tests for serial correlation of the differenced residuals.

    ``gain`` maps Z'u to the estimation error of beta. All orders share one pass.
    """
    if not orders:
        return []
    _, y, x = s.equations()[0]
    back = [f"{_residual(f'b{o}_{y}', [f'b{o}_{c}' for c in x], beta)} AS w_{o}" for o in orders]
    rows = s.rows.selectExpr("*", f"{_residual(y, x, beta)} AS e", *back)
    sums = [f"sum(coalesce(w_{o} * e, 0D)) AS c_{o}" for o in orders]
    sums += [f"sum(coalesce(w_{o} * {c}, 0D)) AS a_{o}_{k}" for o in orders for k, c in enumerate(x)]
    per_entity = _scores(s, rows, beta, sums)
    k, n = len(x), len(orders)
    right = [f"c_{o}" for o in orders] + [f"a_{o}_{i}" for o in orders for i in range(k)] + [f"u_{j}" for j in range(len(s.zd))]
    g = gram(per_entity, (["1D", *[f"c_{o}" for o in orders]], right))
    out = []
    for i, o in enumerate(orders):
        out.append(_ar_row(o, g[0, i], g[i + 1, i], g[0, n + i * k : n + (i + 1) * k], g[i + 1, n + n * k :], gain, vcov))
    return out


def gmm(
    panel: Panel,
    y: str,
    x: Sequence[Term] = (),
    gmm_lags: tuple[int, int] = (2, 99),
    instruments: Sequence[Term] | None = None,
    transformation: str = "d",
    steps: int = 1,
    collapse: bool = True,
    effect: str = INDIVIDUAL,
    robust: bool = True,
    first_step: str = "full",
    ar_orders: Sequence[int] = (1, 2),
    dense_columns: int = DENSE_COLUMNS,
) -> GmmFit:
    """Dynamic panel GMM of y on its first calendar lag and ``x``.

    x: level regressors, ``"name"`` or ``("name", lag)``.
    gmm_lags: lags of y that serve as instruments of the differenced equation.
    instruments: columns used as ordinary instruments; by default the regressors in x.
    transformation: "d" differences (Arellano-Bond), "ld" adds level equations (Blundell-Bond).
    collapse: one instrument per lag instead of one per lag and period.
    robust: Windmeijer's corrected covariance in two steps, the sandwich in one step.
    first_step: weight of the system first step, "full" or "block" (no cross-equation part).
    dense_columns: instruments up to which each is a column of the rows. With one per lag and period
        there can be many more; then rows keep the few that are not zero at their period.
    """
    check_effect(effect)
    panel.check()
    if transformation not in ("d", "ld"):
        raise ValueError(f"transformation must be 'd' or 'ld', not {transformation!r}")
    if first_step not in ("full", "block"):
        raise ValueError(f"first_step must be 'full' or 'block', not {first_step!r}")
    if steps not in (1, 2):
        raise ValueError("steps must be 1 or 2")
    system = transformation == "ld"
    ivs = list(x) if instruments is None else list(instruments)
    full = first_step == "full"
    times = periods_of(panel)
    gmm_lags = (gmm_lags[0], min(gmm_lags[1], times[-1] - times[0]))
    wide = len(ivs) + len(times) * (system + (effect == TWOWAYS) + (0 if collapse else gmm_lags[1] - gmm_lags[0] + 1))
    # Instruments per lag and period are blocks by nature; collapsed ones fill their columns.
    blocks = not collapse and wide > dense_columns
    s = _build(panel, y, list(x), gmm_lags, ivs, system, collapse, effect, full, ar_orders, times, blocks)
    m: _Dense | _Blocks = _Blocks(s, full) if blocks else _Dense(s, full)
    zx, zy, nobs, first_weight = m.first_stage()
    used = np.abs(zx).sum(axis=1) + np.abs(zy) > 0
    w1, _ = _pinv(first_weight)

    def estimate(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bread, _ = _pinv(zx.T @ weight @ zx)
        gain = bread @ zx.T @ weight
        return gain @ zy, bread, gain

    b1, bread1, gain1 = estimate(w1)
    k = len(s.terms)
    windmeijer = steps == 2 and robust
    omega, n_entities = m.score_gram(b1, windmeijer)
    v1 = gain1 @ omega @ gain1.T
    w2, rank = _pinv(omega)
    if steps == 1:
        beta, gain = b1, gain1
        classical = v1 if robust else bread1 * m.one_step_variance(b1, nobs, k)
        vcov = classical
    else:
        beta, classical, gain = estimate(w2)
        vcov = classical
        if robust:
            d = gain @ m.slopes_times(b1, w2 @ (zy - zx @ beta))
            vcov = classical + d @ classical + classical @ d.T + d @ v1 @ d.T
    moment = zy - zx @ beta
    fit = Fit(f"gmm_{transformation}_{steps}step", y, s.terms, beta, vcov, nobs, nobs - k, float("nan"), float("nan"), normal=True, intercept=False)
    out = GmmFit(fit, b1, v1, classical, n_entities, int(used.sum()), rank)
    j, over = float(moment @ w2 @ moment), int(used.sum()) - k
    out.tests.append(("sargan", j, float(over), dist.chi2_upper(j, over)))
    out.tests += m.ar_tests(ar_orders, beta, gain, vcov)
    # The lag and the regressors come first; a regressor may bear any name.
    slopes = list(range(1 + len(x)))
    periods = [i for i in range(k) if i not in slopes]
    for name, idx in (("wald_coefficients", slopes), ("wald_periods", periods)):
        if idx:
            inv, _ = _pinv(vcov[np.ix_(idx, idx)])
            stat = float(beta[idx] @ inv @ beta[idx])
            out.tests.append((name, stat, float(len(idx)), dist.chi2_upper(stat, len(idx))))
    return out


def _ar_row(order: int, total: float, squares: float, a: np.ndarray, zc: np.ndarray, gain: np.ndarray, vcov: np.ndarray) -> tuple[str, float, float, float]:
    var = squares - 2.0 * a @ (gain @ zc) + a @ vcov @ a
    stat = float(total / np.sqrt(var)) if var > 0 else float("nan")
    return f"ar{order}", stat, float("nan"), dist.normal_two_sided(stat)


class _Dense:
    """Moments of a system whose instruments are columns."""

    def __init__(self, s: _System, full: bool):
        self.s, self.full = s, full

    def first_stage(self) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        return *_cross(self.s), _first_weight(self.s, self.full)

    def score_gram(self, beta: np.ndarray, with_x: bool) -> tuple[np.ndarray, int]:
        """Products of entity scores and the number of entities; with ``with_x`` also those with the regressors' scores."""
        k, l = len(self.s.terms), len(self.s.zd)
        entities = _scores(self.s, self.s.rows, beta, with_x=with_x)
        u = [f"u_{j}" for j in range(l)]
        right = u + ([f"x_{i}_{j}" for i in range(k) for j in range(l)] if with_x else [])
        g = gram(entities, ([*u, "1D"], [*right, "CAST(n_eq > 0 AS DOUBLE)"]))
        self.g = g[:-1, :-1]
        return self.g[:, :l], int(round(g[-1, -1]))

    def slopes_times(self, beta: np.ndarray, v: np.ndarray) -> np.ndarray:
        l = len(self.s.zd)
        parts = [self.g[:, l * (i + 1) : l * (i + 2)] for i in range(len(self.s.terms))]
        return np.stack([(p + p.T) @ v for p in parts], axis=1)

    def one_step_variance(self, beta: np.ndarray, nobs: int, k: int) -> float:
        return _one_step_variance(self.s, beta, nobs, k)

    def ar_tests(self, orders, beta, gain, vcov):
        return _ar_tests(self.s, orders, beta, gain, vcov)


class _Blocks:
    """The same moments where rows keep only the instruments of their period."""

    def __init__(self, s: BlockSystem, full: bool):
        self.s, self.full = s, full

    def first_stage(self) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        return self.s.first_stage(self.full)

    def score_gram(self, beta: np.ndarray, with_x: bool) -> tuple[np.ndarray, int]:
        omega, n, self.squares = self.s.score_gram(beta)
        return omega, n

    def slopes_times(self, beta: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.s.slopes_times(beta, v)

    def one_step_variance(self, beta: np.ndarray, nobs: int, k: int) -> float:
        return (self.squares[0] / 2.0 + self.squares[1]) / max(nobs - k, 1)

    def ar_tests(self, orders, beta, gain, vcov):
        if not orders:
            return []
        return [_ar_row(o, *row, gain, vcov) for o, row in zip(orders, self.s.serial(orders, beta))]


def _one_step_variance(s: _System, beta: np.ndarray, nobs: int, k: int) -> float:
    """Error variance for the classical one-step covariance; differenced errors carry it twice."""
    squares = [f"sum(power({_residual(y, x, beta)}, 2))" for _, y, x in s.equations()]
    ssr = [v or 0.0 for v in s.rows.selectExpr(*squares).first()]
    return (ssr[0] / 2.0 + sum(ssr[1:])) / max(nobs - k, 1)
