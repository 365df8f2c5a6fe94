"""Panel models: first difference, within (one- and two-way), random effects.

One grouped aggregate turns rows into one moment row per entity (count, means, centred products).
Everything else is a second aggregate over those rows: pooled within moments, between moments,
random-effects weights, and cluster scores, which equal s_xy - s_xx b for each entity.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import missing
from ..operators.panel import CALENDAR, Panel
from ..session import materialise
from . import two_way
from .linear import INTERCEPT, Fit, inverse, ols, singular, spread
from .moments import Moments, group, moment_sql, moments, number, pairs, symmetric
from .triangular import independent, triangular

INDIVIDUAL, TWOWAYS = "individual", "twoways"
#: Periods up to which the normal equations of period effects are formed, one row and column per period.
DENSE_PERIODS = 400


def check_effect(effect: str) -> str:
    if effect not in (INDIVIDUAL, TWOWAYS):
        raise ValueError(f"effect must be 'individual' or 'twoways', not {effect!r}")
    return effect


def entity_moments(panel: Panel, columns: Sequence[str]) -> DataFrame:
    """One row per entity: n, m_i and s_i_j of the columns over complete rows."""
    kept = missing.finite_cases(panel.df, columns)
    return group(kept, panel.entity, moment_sql(columns))


@dataclass
class PanelMoments:
    """Sums over entity rows: within products, and products of (1, means) under weights of the entity's length."""

    names: list[str]
    nobs: int
    entities: int
    within: np.ndarray  # [p, p] summed centred products
    between: dict[str, np.ndarray]  # weight in SQL -> [p + 1, p + 1]

    def within_moments(self) -> Moments:
        return Moments(self.names, self.nobs, np.zeros(len(self.names)), self.within)


def pool(entities: DataFrame, names: Sequence[str], weights: Sequence[str] = ()) -> PanelMoments:
    """Add entity moments up in one row. ``weights`` are SQL expressions of n, an entity's number of rows."""
    p = len(names)
    side = ["1D", *[f"m_{i}" for i in range(p)]]
    aggs = ["count(1) AS c", "sum(n) AS n"] + [f"sum(s_{i}_{j}) AS s_{i}_{j}" for i, j in pairs(p)]
    for k, w in enumerate(weights):
        aggs += [f"sum(({w}) * {side[i]} * {side[j]}) AS b{k}_{i}_{j}" for i, j in pairs(p + 1)]
    row = group(entities, (), aggs).first().asDict()
    between = {w: symmetric(row, p + 1, f"b{k}_") for k, w in enumerate(weights)}
    return PanelMoments(list(names), int(row["n"] or 0), int(row["c"]), symmetric(row, p), between)


# First difference ----------------------------------------------------------------------------


def differenced(panel: Panel, columns: Sequence[str], lag_mode: str = CALENDAR) -> DataFrame:
    """Columns replaced by their first differences; first observations drop out of a fit as NULL."""
    names = list(dict.fromkeys(columns))
    return panel.df.select(*panel.entity, panel.time, *[panel.diff(c, lag_mode).alias(c) for c in names])


def first_difference(panel: Panel, y: str, x: Sequence[str], lag_mode: str = CALENDAR) -> Fit:
    """Least squares on first differences, intercept kept."""
    fit = ols(differenced(panel, [y, *x], lag_mode), y, x)
    fit.model = "fd"
    return fit


# Within --------------------------------------------------------------------------------------


def periods_of(panel: Panel) -> list:
    """The periods of a panel in order; the unique key lets none occur twice in an entity."""
    return sorted(r[0] for r in panel.df.select(panel.time).distinct().collect())


def time_effects(panel: Panel, columns: Sequence[str]) -> tuple[list, np.ndarray]:
    """Period effects of each column in its two-way decomposition, for any unbalanced panel.

    The normal equations of entity-demeaned period dummies need only, per pair of periods, the sum
    of 1 / T over entities that have both, and per period the sum of entity means. They are counted
    in long form, so any number of periods will do; the unique key bounds an entity's list of periods.
    Returns periods and a [period, column] array, the first period being zero.
    """
    names, t = list(columns), panel.time
    sums = [f"sum(`{c}`) AS t_{j}" for j, c in enumerate(names)]
    per_time = sorted(group(panel.df, [t], ["count(1) AS n", *sums]).collect(), key=lambda r: r[t])
    times = [r[t] for r in per_time]
    means = [f"avg(`{c}`) AS m_{j}" for j, c in enumerate(names)]
    per_entity = group(panel.df, panel.entity, ["count(1) AS n", f"collect_list(`{t}`) AS seen", *means])
    first = per_entity.selectExpr("n", "seen", *[f"m_{j}" for j in range(len(names))], "explode(seen) AS a")
    k, q, place = len(times), len(names), {p: i for i, p in enumerate(times)}
    lhs = np.diag([float(r["n"]) for r in per_time])
    rhs = np.array([[r[f"t_{j}"] for j in range(q)] for r in per_time], dtype=float).reshape(k, q)
    for r in group(first, ["a"], [f"sum(m_{j}) AS m_{j}" for j in range(q)]).collect():
        rhs[place[r["a"]]] -= [r[f"m_{j}"] for j in range(q)]
    # A symmetric matrix: one of each two mirrored pairs is enough.
    both = first.selectExpr("n", "a", "explode(filter(seen, s -> s <= a)) AS b")
    for r in group(both, ["a", "b"], ["sum(1D / n) AS v"]).collect():
        i, j = place[r["a"]], place[r["b"]]
        lhs[i, j] -= r["v"]
        if i != j:
            lhs[j, i] -= r["v"]
    effects = np.zeros((k, q))
    # Least squares with the first effect at zero; periods cut off from the rest stay at zero.
    effects[1:] = np.linalg.lstsq(lhs[1:, 1:], rhs[1:], rcond=1e-12)[0]
    return times, effects


def _net_of_time(panel: Panel, column: str, times: list, effects: Sequence[float]) -> str:
    cases = " ".join(f"WHEN {p!r} THEN {number(e)}" for p, e in zip(times, effects))
    return f"`{column}` - CASE `{panel.time}` {cases} END AS `{column}`"


def remove_time_effects(panel: Panel, columns: Sequence[str]) -> tuple[Panel, int]:
    """Panel whose columns are net of period effects; entity-demeaning it completes the two-way
    transform. Returns it with the number of free period effects.

    Up to ``DENSE_PERIODS`` periods the normal equations are solved as they are, with more by
    conjugate gradients."""
    columns = list(dict.fromkeys(columns))
    kept = materialise(missing.finite_cases(panel.df, columns).select(*panel.entity, panel.time, *columns))
    # Two rows of one entity and period would count as one presence but two rows.
    base = panel.on(kept).check()
    if kept.select(panel.time).distinct().count() > DENSE_PERIODS:
        effects = two_way.graph_effects(base, columns)
        return base.on(materialise(two_way.net_of_effects(kept, panel.time, columns, effects))), effects.periods - 1
    times, effects = time_effects(base, columns)
    net = [_net_of_time(panel, c, times, effects[:, j]) for j, c in enumerate(columns)]
    keys = [f"`{c}`" for c in (*panel.entity, panel.time)]
    return base.on(kept.selectExpr(*keys, *net)), len(times) - 1


@dataclass
class WithinFit:
    """A within fit with the entity moments it came from; ``names`` are the outcome and the regressors estimated."""

    fit: Fit
    entities: DataFrame
    names: list[str]
    panel: Panel

    def cluster_vcov(self, scale: str = "hc1") -> np.ndarray:
        """Cluster-robust covariance by entity (Arellano 1987).

        An entity's score is s_xy - s_xx b, so the meat needs no pass over the rows. ``hc1`` scales
        by n / (n - k) with k the slopes; ``none`` does not scale.
        """
        k = len(self.names) - 1
        beta = self.fit.without_aliased().beta
        score = []
        for i in range(1, k + 1):
            terms = [f"{number(b)} * s_{min(i, j)}_{max(i, j)}" for j, b in enumerate(beta, 1)]
            score.append(f"s_0_{i} - ({' + '.join(terms)}) AS v_{i}")
        meat = [f"sum(v_{i + 1} * v_{j + 1}) AS g_{i}_{j}" for i, j in pairs(k)]
        row = self.entities.selectExpr(*score).selectExpr(*meat).first().asDict()
        bread = self.fit.extra["bread"]
        n = self.fit.nobs
        v = (n / (n - k) if scale == "hc1" else 1.0) * bread @ symmetric(row, k, "g_") @ bread
        return spread(v, self.names[1:], self.fit.terms)

    def residuals(self) -> DataFrame:
        """Rows with the within residual."""
        y, x = self.names[0], self.names[1:]
        kept = self.panel.on(missing.finite_cases(self.panel.df, self.names))
        rows = kept.demean(self.names)
        e = F.col(f"{y}_w")
        for c, b in zip(x, self.fit.without_aliased().beta):
            e = e - F.lit(float(b)) * F.col(f"{c}_w")
        return rows.select(*self.panel.entity, self.panel.time, e.alias("residual"))


def within(panel: Panel, y: str, x: Sequence[str], effect: str = INDIVIDUAL) -> WithinFit:
    """Fixed-effects regression; ``twoways`` adds period effects, exact on unbalanced panels.

    Regressors that the effects and earlier regressors explain are aliased: the fit is the one without
    them, and their coefficients are NaN.
    """
    check_effect(effect)
    names = [y, *x]
    free = 0
    given = panel
    if effect == TWOWAYS:
        panel, free = remove_time_effects(panel, names)
    entities = entity_moments(panel, names)
    pm = pool(entities, names, ["n"])
    m = pm.within_moments()
    raw = np.diag(pm.between["n"])[2:] + np.diag(m.block(x, x))
    if x and pm.nobs and singular(m, x, raw):
        kept = _net_of_effects(given, panel, list(x), names)
        if len(kept) < len(x):
            # The rows stay those that are complete in all columns asked for.
            rest = panel.on(missing.finite_cases(panel.df, names))
            found = _within(rest, y, kept, effect, free, entity_moments(rest, [y, *kept]))
            return replace(found, fit=found.fit.with_aliased(x))
    return _within(panel, y, list(x), effect, free, entities, pm)


def _net_of_effects(given: Panel, panel: Panel, x: list[str], names: Sequence[str]) -> list[str]:
    """Regressors that neither the effects nor earlier regressors explain, compared with their own sizes before the effects went."""
    kept = panel.on(missing.finite_cases(panel.df, names))
    r = triangular(kept.demean(x), [f"`{c}_w`" for c in x])
    return [x[j] for j in independent(r, sizes(given, x, names))]


def sizes(given: Panel, x: Sequence[str], names: Sequence[str]) -> np.ndarray:
    """Lengths of columns over the rows complete in ``names``."""
    row = missing.finite_cases(given.df, names).selectExpr(*[f"sqrt(sum(`{c}` * `{c}`))" for c in x]).first()
    return np.array(row, dtype=float)


def _within(panel: Panel, y: str, x: list[str], effect: str, free: int, entities: DataFrame, pm: PanelMoments | None = None) -> "WithinFit":
    names = [y, *x]
    pm = pm or pool(entities, names)
    m = pm.within_moments()
    sxx, sxy, syy = m.block(x, x), m.block(x, [y])[:, 0], m.block([y], [y])[0, 0]
    inv = inverse(sxx)
    beta = inv @ sxy
    rss = max(float(syy - sxy @ beta), 0.0)
    df = pm.nobs - pm.entities - free - len(x)
    sigma2 = rss / df if df > 0 else float("nan")
    fit = Fit(f"within_{effect}", y, list(x), beta, sigma2 * inv, pm.nobs, df, rss, float(syy), intercept=False)
    fit.extra = {"bread": inv, "entities": pm.entities, "period_effects": free}
    return WithinFit(fit, entities, names, panel)


# Random effects ------------------------------------------------------------------------------


@dataclass
class RandomFit:
    fit: Fit
    sigma2_e: float
    sigma2_u: float

    def theta(self, n: str | Column) -> Column:
        """Share of the entity mean that is removed, by entity length."""
        t = missing.col(n)
        return 1.0 - F.sqrt(F.lit(self.sigma2_e) / (t * F.lit(self.sigma2_u) + F.lit(self.sigma2_e)))

    def transformed(self, panel: Panel) -> tuple[DataFrame, list[str]]:
        """Rows of the quasi-demeaned regression: ``residual`` and the regressors, whose names are returned; the first is the constant's."""
        from ..operators.aggregate import attach_group

        y, x = self.fit.y, self.fit.terms[1:]
        kept = missing.finite_cases(panel.df, [y, *x]).select(*panel.entity, panel.time, y, *x)
        stats = {"__n": F.count(F.lit(1)), **{f"__m_{c}": F.avg(c) for c in [y, *x]}}
        rows = attach_group(kept, panel.entity, stats).withColumn("__th", self.theta("__n"))
        q = lambda c: F.col(c) - F.col("__th") * F.col(f"__m_{c}")
        e = q(y) - F.lit(float(self.fit.beta[0])) * (1.0 - F.col("__th"))
        for c, b in zip(x, self.fit.beta[1:]):
            e = e - F.lit(float(b)) * q(c)
        names = [f"__q_{i}" for i in range(len(x) + 1)]
        regressors = [(1.0 - F.col("__th")).alias(names[0]), *[q(c).alias(n) for c, n in zip(x, names[1:])]]
        return rows.select(*panel.entity, panel.time, e.alias("residual"), *regressors), names

    def transformed_residuals(self, panel: Panel) -> DataFrame:
        """Residuals of the quasi-demeaned regression."""
        return self.transformed(panel)[0].select(*panel.entity, panel.time, "residual")


def random_effects(panel: Panel, y: str, x: Sequence[str]) -> RandomFit:
    """Feasible GLS with Swamy-Arora components, in the form of Baltagi and Chang (1994) for
    unbalanced panels. One pass over the rows, two over the entity moments."""
    names = [y, *x]
    k = len(x)
    entities = materialise(entity_moments(panel, names))
    pm = pool(entities, names, ["n", "CAST(n AS DOUBLE) * n"])
    n, big_n = pm.entities, pm.nobs
    w = pm.within_moments()
    wxx, wxy = w.block(x, x), w.block(x, [y])[:, 0]
    winv = inverse(wxx)
    sigma2_e = float(w.block([y], [y])[0, 0] - wxy @ (winv @ wxy)) / (big_n - n - k)

    # Positions in raw between matrices: 0 the constant, 1 y, 2.. regressors.
    xi = [0, *range(2, 2 + k)]
    b, b2 = pm.between.values()
    bxx, bxy = b[np.ix_(xi, xi)], b[xi, 1]
    binv = inverse(bxx)
    rss_b = float(b[1, 1] - bxy @ (binv @ bxy))
    trace = float(np.trace(binv @ b2[np.ix_(xi, xi)]))
    sigma2_u = max((rss_b - (n - k - 1) * sigma2_e) / (big_n - trace), 0.0)

    # Quasi-demeaned products: within part plus T (1 - theta)^2 times the mean products.
    weight = f"n * {number(sigma2_e)} / (n * {number(sigma2_u)} + {number(sigma2_e)})"
    g = pool(entities, names, [weight]).between[weight]
    g[1:, 1:] += w.cross
    gxx, gxy = g[np.ix_(xi, xi)], g[xi, 1]
    ginv = inverse(gxx)
    beta = ginv @ gxy
    rss = max(float(g[1, 1] - gxy @ beta), 0.0)
    df = big_n - k - 1
    tss = float(g[1, 1] - g[0, 1] ** 2 / g[0, 0])
    fit = Fit("random", y, [INTERCEPT, *x], beta, (rss / df) * ginv, big_n, df, rss, tss)
    fit.extra = {"sigma2_idios": sigma2_e, "sigma2_id": sigma2_u, "entities": n}
    return RandomFit(fit, sigma2_e, sigma2_u)
