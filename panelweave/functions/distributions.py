"""Tail probabilities for test statistics (small helpers applied to finished statistics only)."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _lentz(step, tiny: float = 1e-300, rounds: int = 500, tol: float = 1e-15) -> float:
    """Modified Lentz evaluation of a continued fraction b0 + a1/(b1 + a2/(b2 + ...))."""
    b0 = step(0)[1] or tiny
    f, c, d = b0, b0, 0.0
    for j in range(1, rounds):
        a, b = step(j)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1.0 / d
        f *= c * d
        if abs(c * d - 1.0) < tol:
            break
    return f


def _beta_fraction(x: float, a: float, b: float) -> float:
    def step(j):
        if j == 0:
            return 0.0, 0.0
        if j == 1:
            return 1.0, 1.0
        m, odd = divmod(j - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return _lentz(step)


def beta_regularised(x: float, a: float, b: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)

    def step(j):
        if j == 0:
            return 0.0, 0.0
        if j == 1:
            return 1.0, x + 1.0 - a
        return -(j - 1) * (j - 1 - a), x + 2 * j - 1 - a

    return front * _lentz(step)


def t_two_sided(t: float, df: float) -> float:
    if df <= 0 or math.isnan(t):
        return float("nan")
    if df > 1e9:
        # The normal limit; the fraction loses digits there.
        return normal_two_sided(t)
    return beta_regularised(df / (df + t * t), df / 2.0, 0.5)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile: the t with two-sided tail 2(1-p), by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_two_sided(mid, df) / 2.0 > 1.0 - p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def f_upper(f: float, df1: float, df2: float) -> float:
    if df1 <= 0 or df2 <= 0 or math.isnan(f):
        return float("nan")
    if math.isinf(f):
        return 0.0
    return beta_regularised(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    if df <= 0 or math.isnan(x):
        return float("nan")
    return gamma_upper(df / 2.0, x / 2.0)
