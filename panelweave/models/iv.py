"""Two-stage least squares and its diagnostics, all from one moment matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions import distributions as dist, missing
from ..operators.panel import CALENDAR, Panel
from .linear import INTERCEPT, Fit, inverse, ols, singular, with_intercept
from .moments import Moments, moments
from .panel_models import TWOWAYS, check_effect, differenced, entity_moments, pool, remove_time_effects, sizes
from .triangular import independent, projected, triangular


def _rss(m: Moments, y: str, x: Sequence[str]) -> float:
    sxy = m.block(x, [y])[:, 0]
    return float(m.block([y], [y])[0, 0] - sxy @ (inverse(m.block(x, x)) @ sxy))


def _f(restricted: float, free: float, q: int, df: int) -> float:
    """F statistic of q restrictions; infinite where the free model fits exactly."""
    if df <= 0 or free != free:
        return float("nan")
    return ((restricted - free) / q) / (free / df) if free > 0 else float("inf")


def two_stage(
    m: Moments,
    y: str,
    endog: Sequence[str],
    exog: Sequence[str],
    instruments: Sequence[str],
    intercept: bool = True,
    lost_df: int = 0,
    model: str = "2sls",
) -> Fit:
    """2SLS on centred (or within) moments; ``lost_df`` counts effects removed beforehand."""
    x, z = [*endog, *exog], [*exog, *instruments]
    szz, szx, szy = inverse(m.block(z, z)), m.block(z, x), m.block(z, [y])[:, 0]
    proj = szx.T @ szz
    inv = inverse(proj @ szx)
    slopes = inv @ (proj @ szy)
    syy, sxy = float(m.block([y], [y])[0, 0]), m.block(x, [y])[:, 0]
    rss = float(syy - 2 * slopes @ sxy + slopes @ m.block(x, x) @ slopes)
    df = m.n - lost_df - len(x) - (1 if intercept else 0)
    sigma2 = rss / df if df > 0 else float("nan")
    vs = sigma2 * inv
    if intercept:
        beta, vcov = with_intercept(m, x, y, slopes, vs, sigma2)
        terms = [INTERCEPT, *x]
    else:
        beta, vcov, terms = slopes, vs, list(x)
    fit = Fit(model, y, terms, beta, vcov, m.n, df, rss, syy, intercept=intercept)
    fit.extra["diagnostics"] = diagnostics(m, y, endog, exog, instruments, slopes, rss, intercept, lost_df)
    return fit


def diagnostics(
    m: Moments,
    y: str,
    endog: Sequence[str],
    exog: Sequence[str],
    instruments: Sequence[str],
    slopes: np.ndarray,
    rss: float,
    intercept: bool = True,
    lost_df: int = 0,
) -> list[tuple[str, float, float, float, float]]:
    """(test, df1, df2, statistic, p) for weak instruments, Wu-Hausman and Sargan.

    Columns built from fitted values are linear combinations of observed ones, so their moments
    follow from the same matrix.
    """
    x, z = [*endog, *exog], [*exog, *instruments]
    c = (1 if intercept else 0) + lost_df
    out = []
    q, df2 = len(instruments), m.n - len(z) - c
    for e in endog:
        r0, r1 = _rss(m, e, list(exog)) if exog else float(m.block([e], [e])[0, 0]), _rss(m, e, z)
        f = _f(r0, r1, q, df2)
        name = "weak_instruments" if len(endog) == 1 else f"weak_instruments_{e}"
        out.append((name, float(q), float(df2), f, dist.f_upper(f, q, df2)))

    aug, residuals = m, []
    for e in endog:
        pi = inverse(m.block(z, z)) @ m.block(z, [e])[:, 0]
        weights = {e: 1.0}
        for name, w in zip(z, pi):
            weights[name] = weights.get(name, 0.0) - float(w)
        aug = aug.extend(f"__v_{e}", weights)
        residuals.append(f"__v_{e}")
    r0, r1 = _rss(aug, y, x), _rss(aug, y, [*x, *residuals])
    k, df2 = len(endog), m.n - len(x) - len(endog) - c
    f = _f(r0, r1, k, df2)
    out.append(("wu_hausman", float(k), float(df2), f, dist.f_upper(f, k, df2)))

    over = len(z) - len(x)
    if over > 0:
        szu = m.block(z, [y])[:, 0] - m.block(z, x) @ slopes
        stat = float(m.n * (szu @ inverse(m.block(z, z)) @ szu) / rss)
        out.append(("sargan", float(over), float("nan"), stat, dist.chi2_upper(stat, over)))
    else:
        out.append(("sargan", 0.0, float("nan"), float("nan"), float("nan")))
    return out


def _of_rank(
    frame: DataFrame,
    m: Moments,
    y: str,
    endog: Sequence[str],
    exog: Sequence[str],
    instruments: Sequence[str],
    intercept: bool = True,
    lost_df: int = 0,
    model: str = "2sls",
    column: Callable[[str], str] = lambda c: f"`{c}`",
    size: Callable[[Sequence[str]], np.ndarray] | None = None,
) -> Fit:
    """``two_stage`` without the instruments and regressors that earlier ones explain.

    ``frame`` holds the rows behind ``m`` under the names ``column`` gives; it is read only where the moments
    are singular. ``size`` gives the columns' lengths before effects were taken out.
    """
    if len(instruments) < len(endog):
        raise ValueError("fewer instruments than endogenous regressors")
    x, z = [*endog, *exog], [*exog, *instruments]
    raw = size(z) ** 2 if size else None
    if not singular(m, z, raw):
        szz, szx = inverse(m.block(z, z)), m.block(z, x)
        if np.all(np.isfinite(inverse(szx.T @ szz @ szx))):
            return two_stage(m, y, endog, exog, instruments, intercept, lost_df, model)
    c = int(intercept)
    r = triangular(frame, [column(n) for n in [*z, *endog]], intercept)
    lengths = np.linalg.norm(r, axis=0)
    if size:
        lengths[c:] = size([*z, *endog])
    width = c + len(z)
    kept_z = independent(r[:, :width], lengths[:width])
    fitted = projected(r, kept_z, range(width, width + len(endog)))
    stage = np.column_stack([r[:, :c], fitted, r[:, c : c + len(exog)]])
    order = [*range(c), *range(width, width + len(endog)), *range(c, c + len(exog))]
    kept_x = independent(stage, lengths[order])
    named = [x[j - c] for j in kept_x if j >= c]
    keep_z = [z[j - c] for j in kept_z if j >= c]
    some = [e for e in endog if e in named]
    others = [e for e in exog if e in named]
    fit = two_stage(m, y, some, others, [n for n in keep_z if n not in exog], intercept, lost_df, model)
    return fit.with_aliased([*([INTERCEPT] if intercept else []), *x])


def iv(df: DataFrame, y: str, endog: Sequence[str], exog: Sequence[str], instruments: Sequence[str]) -> Fit:
    """Cross-section 2SLS with intercept. Aliased regressors have NaN, aliased instruments take no part."""
    names = [y, *endog, *exog, *instruments]
    return _of_rank(missing.finite_cases(df, names), moments(df, names), y, endog, exog, instruments)


def iv_within(
    panel: Panel,
    y: str,
    endog: Sequence[str],
    exog: Sequence[str],
    instruments: Sequence[str],
    effect: str = TWOWAYS,
) -> Fit:
    """2SLS on within-transformed variables."""
    names = [y, *endog, *exog, *instruments]
    free, given = 0, panel
    if check_effect(effect) == TWOWAYS:
        panel, free = remove_time_effects(panel, names)
    pm = pool(entity_moments(panel, names), names, ["n"])
    m = pm.within_moments()
    total = dict(zip(names, np.diag(pm.between["n"])[1:] + np.diag(m.cross)))
    rows = panel.on(missing.finite_cases(panel.df, names)).demean([*endog, *exog, *instruments])
    before = sizes if free else None
    size = (lambda cs: before(given, cs, names)) if before else (lambda cs: np.sqrt([total[c] for c in cs]))
    return _of_rank(
        rows, m, y, endog, exog, instruments, False, pm.entities + free, f"2sls_within_{effect}", lambda c: f"`{c}_w`", size
    )


def iv_first_difference(
    panel: Panel,
    y: str,
    endog: Sequence[str],
    exog: Sequence[str],
    instruments: Sequence[str],
    lag_mode: str = CALENDAR,
) -> Fit:
    """2SLS on first differences, intercept kept."""
    names = [y, *endog, *exog, *instruments]
    rows = differenced(panel, names, lag_mode)
    m = moments(rows, names)
    return _of_rank(missing.finite_cases(rows, names), m, y, endog, exog, instruments, model="2sls_fd")


def reduced_form(df: DataFrame, y: str, x: Sequence[str]) -> Fit:
    """Instrument relevance: plain regression on the instruments."""
    fit = ols(df, y, x)
    fit.model = "reduced_form"
    return fit
