"""Pooled and grouped least squares on moment matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import distributions as dist, missing
from ..operators import aggregate
from ..operators.grouped import Grouped, apply_grouped
from ..operators.joins import small_side
from ..session import materialise, ship_package
from .moments import Moments, group, moment_sql, moments, number, pairs, symmetric
from .triangular import TOLERANCE, independent, triangular

INTERCEPT = "(Intercept)"
TIDY = "term string, estimate double, std_error double, statistic double, p_value double"


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric matrix after scaling to unit diagonal; NaN when it is singular."""
    d = np.sqrt(np.abs(np.diag(a)))
    if a.size == 0:
        return a
    if not np.all(np.isfinite(a)) or np.any(d == 0):
        return np.full_like(a, np.nan)
    s = a / np.outer(d, d)
    if np.linalg.matrix_rank(s, tol=1e-11) < len(a):
        return np.full_like(a, np.nan)
    return np.linalg.inv(s) / np.outer(d, d)


@dataclass
class Fit:
    """An estimated model: numbers only, the data stays in Spark."""

    model: str
    y: str
    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    nobs: int
    df_resid: float
    rss: float
    tss: float
    normal: bool = False
    # Slopes tested by the overall F (all but the intercept).
    intercept: bool = True
    extra: dict = field(default_factory=dict)

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_resid if self.df_resid > 0 else float("nan")

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0.0))

    @property
    def kept(self) -> np.ndarray:
        """Which terms are estimated; aliased ones have NaN for coefficient and error."""
        return ~np.isnan(self.beta)

    def p_values(self, stat: np.ndarray) -> list[float]:
        if self.normal:
            return [dist.normal_two_sided(s) for s in stat]
        return [dist.t_two_sided(s, self.df_resid) for s in stat]

    def rows(self, vcov: np.ndarray | None = None) -> list[tuple]:
        se = self.std_error if vcov is None else np.sqrt(np.maximum(np.diag(vcov), 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = self.beta / se
        out = []
        for t, b, s, z in zip(self.terms, self.beta, se, stat):
            out.append((t, None, None, None, None) if np.isnan(b) else (t, float(b), float(s), float(z), float(self.p_values([z])[0])))
        return out

    def tidy(self, spark: SparkSession, vcov: np.ndarray | None = None) -> DataFrame:
        """Coefficient table, optionally with another covariance matrix."""
        return spark.createDataFrame(self.rows(vcov), TIDY)

    def coefficient(self, term: str) -> float:
        return float(self.beta[self.terms.index(term)])

    def summary(self) -> dict:
        if not self.kept.all() and self.kept.any():
            return self.without_aliased().summary()
        k = len(self.terms) - (1 if self.intercept else 0)
        r2 = 1.0 - self.rss / self.tss if self.tss else float("nan")
        total_df = self.nobs - 1
        adj = 1.0 - (1.0 - r2) * total_df / self.df_resid if self.df_resid > 0 else float("nan")
        # Wald form over the slopes: the classical F for least squares, and valid for 2SLS too.
        slopes = slice(1, None) if self.intercept else slice(None)
        b, v = self.beta[slopes], self.vcov[slopes, slopes]
        f = float(b @ inverse(v) @ b) / k if k and self.df_resid > 0 else float("nan")
        return {
            "nobs": self.nobs,
            "df_resid": self.df_resid,
            "sigma": float(np.sqrt(self.sigma2)),
            "r_squared": r2,
            "adj_r_squared": adj,
            "f_statistic": f,
            "f_p_value": dist.f_upper(f, k, self.df_resid),
        }

    def without_aliased(self) -> "Fit":
        at = np.flatnonzero(self.kept)
        return replace(self, terms=[self.terms[i] for i in at], beta=self.beta[at], vcov=self.vcov[np.ix_(at, at)])

    def with_aliased(self, terms: Sequence[str]) -> "Fit":
        """The same fit over more terms, those not estimated being aliased."""
        return replace(self, terms=list(terms), beta=spread(self.beta, self.terms, terms), vcov=spread(self.vcov, self.terms, terms))

    def fitted_sql(self) -> str:
        """Fitted value as an expression over the model columns (pooled models)."""
        return " + ".join(
            number(b) if t == INTERCEPT else f"{number(b)} * `{t}`" for t, b in zip(self.terms, self.beta) if not np.isnan(b)
        )

    def with_residuals(self, df: DataFrame, name: str = "residual") -> DataFrame:
        return df.withColumn(name, F.expr(f"`{self.y}` - ({self.fitted_sql()})"))


def spread(values: np.ndarray, names: Sequence[str], over: Sequence[str]) -> np.ndarray:
    """A vector or matrix over ``names`` as one over ``over``, NaN where that has more."""
    at = [list(over).index(n) for n in names]
    out = np.full((len(over),) * values.ndim, np.nan)
    out[np.ix_(*[at] * values.ndim)] = values
    return out


def singular(m: Moments, x: Sequence[str], raw: np.ndarray | None = None) -> bool:
    """Whether some regressors may be aliased: no inverse, or a column that the constant (or the entities) all but explains.

    ``raw`` are the columns' sums of squares before centring.
    """
    cross = m.block(x, x)
    raw = np.diag(cross) + m.n * m.mean[m.at(x)] ** 2 if raw is None else raw
    return bool(np.any(np.diag(cross) <= TOLERANCE**2 * raw)) or not np.all(np.isfinite(inverse(cross)))


def with_intercept(m: Moments, x: Sequence[str], y: str, slopes: np.ndarray, vs: np.ndarray, sigma2: float):
    """Prepend the intercept to slopes estimated on centred moments."""
    mx, my = m.mean[m.at(x)], m.mean[m.at([y])][0]
    beta = np.concatenate([[my - mx @ slopes], slopes])
    cov = -vs @ mx
    top = np.concatenate([[sigma2 / m.n + mx @ vs @ mx], cov])
    return beta, np.vstack([top, np.column_stack([cov, vs])])


def least_squares(m: Moments, y: str, x: Sequence[str], model: str = "ols") -> Fit:
    """Regression with intercept from centred moments."""
    sxx, sxy, syy = m.block(x, x), m.block(x, [y])[:, 0], m.block([y], [y])[0, 0]
    inv = inverse(sxx)
    slopes = inv @ sxy
    rss = max(float(syy - sxy @ slopes), 0.0)
    df = m.n - len(x) - 1
    sigma2 = rss / df if df > 0 else float("nan")
    beta, vcov = with_intercept(m, x, y, slopes, sigma2 * inv, sigma2)
    return Fit(model, y, [INTERCEPT, *x], beta, vcov, m.n, df, rss, float(syy))


def ols(df: DataFrame, y: str, x: Sequence[str]) -> Fit:
    """Pooled least squares with intercept and listwise deletion; one aggregate.

    Regressors that the constant and earlier regressors explain are aliased: their coefficient is NaN (NULL
    in tables) and the others are those of the regression without them. Only then the rows are read again.
    """
    return _least_squares_of_rank(df, moments(df, [y, *x]), y, list(x))


def _least_squares_of_rank(df: DataFrame, m: Moments, y: str, x: list[str]) -> Fit:
    if not m.n or not x or not singular(m, x):
        return least_squares(m, y, x)
    r = triangular(missing.finite_cases(df, [y, *x]), [f"`{c}`" for c in x], intercept=True)
    kept = [x[j - 1] for j in independent(r) if j]
    return least_squares(m, y, kept).with_aliased([INTERCEPT, *x])


def residual_quantiles(df: DataFrame, residual: str = "residual") -> DataFrame:
    """Minimum, quartiles and maximum of a residual column, exact and without a global sort."""
    names = ["min", "q1", "median", "q3", "max"]
    out = aggregate.quantiles(df, [], [residual], [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select(*[F.col(residual)[i].alias(n) for i, n in enumerate(names)])


# Heteroskedasticity-robust covariance --------------------------------------------------------


def _meat_sql(residual: str, centred: Sequence[str]) -> list[str]:
    z = ["1D", *centred]
    return [f"sum({residual} * {residual} * {z[i]} * {z[j]}) AS g_{i}_{j}" for i, j in pairs(len(z))]


def hc1(df: DataFrame, fit: Fit, m: Moments) -> np.ndarray:
    """White covariance scaled by n / (n - k): a second aggregate of squared residual products."""
    every = [t for t in fit.terms if t != INTERCEPT]
    x = [t for t, k in zip(fit.terms, fit.kept) if k and t != INTERCEPT]
    kept = missing.finite_cases(df, [fit.y, *every])
    centred = [f"(`{c}` - {number(v)})" for c, v in zip(x, m.mean[m.at(x)])]
    p = len(x) + 1
    row = group(kept, (), _meat_sql(f"(`{fit.y}` - ({fit.fitted_sql()}))", centred)).first().asDict()
    return spread(sandwich(symmetric(row, p, "g_"), m, x, m.n / (m.n - p)), [INTERCEPT, *x], fit.terms)


def sandwich(meat: np.ndarray, m: Moments, x: Sequence[str], scale: float) -> np.ndarray:
    """bread * meat * bread for centred regressors, mapped back to the intercept at zero."""
    p = len(x) + 1
    bread = np.zeros((p, p))
    bread[0, 0] = 1.0 / m.n
    bread[1:, 1:] = inverse(m.block(x, x))
    v = scale * bread @ meat @ bread
    shift = np.eye(p)
    shift[0, 1:] = -m.mean[m.at(x)]
    return shift @ v @ shift.T


def ols_robust(df: DataFrame, y: str, x: Sequence[str], rescan: bool = False) -> tuple[Fit, np.ndarray]:
    """Fit and HC1 covariance in two passes.

    The model frame is written once for both, unless ``rescan`` says that reading it again is
    cheaper, as for a plain scan of stored columns.
    """
    frame = missing.finite_cases(df, [y, *x]).select(y, *x)
    frame = frame if rescan else materialise(frame)
    m = moments(frame, [y, *x])
    fit = _least_squares_of_rank(frame, m, y, list(x))
    return fit, hc1(frame, fit, m)


# Grouped regressions -------------------------------------------------------------------------


def _per_row(solve: Callable[[dict], list[dict]], names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = [r for rec in pdf.to_dict("records") for r in solve(rec)]
            yield pd.DataFrame(out, columns=names)

    return run


def _by_elimination(m: Moments, y: str, x: list[str]) -> Fit:
    """Least squares on moments alone; regressors are taken in order, those already explained are aliased."""
    if not singular(m, x):
        return least_squares(m, y, x)
    raw = np.diag(m.block(x, x)) + m.n * m.mean[m.at(x)] ** 2
    kept: list[str] = []
    for c, size in zip(x, raw):
        own = m.block([c], [c])[0, 0]
        cov = m.block(kept, [c])[:, 0]
        # What earlier regressors leave of it; sums of products have half the digits.
        left = own - (cov @ inverse(m.block(kept, kept)) @ cov if kept else 0.0)
        if left > max(TOLERANCE**2 * size, 1e-11 * own):
            kept.append(c)
    return least_squares(m, y, kept).with_aliased([INTERCEPT, *x])


def grouped_ols(
    df: DataFrame,
    by: Sequence[str],
    y: str,
    x: Sequence[str],
    robust: bool = True,
    digits: int | None = 4,
    rescan: bool = False,
) -> DataFrame:
    """One regression per group, as a tidy coefficient frame.

    Moments of all groups come from one aggregate. Solving works on one row per group, distributed
    by Spark, so neither rows of a group nor the groups are gathered in one place. With ``robust``
    the coefficients are joined back for the HC1 aggregate. Groups with too few rows give no rows. A regressor
    that earlier ones explain inside a group is aliased there: its row has the term only.
    """
    x, by = list(x), list(by)
    ship_package(df.sparkSession)
    names = [y, *x]
    k = len(x) + 1
    frame = missing.finite_cases(df, names).filter(" AND ".join(f"`{b}` IS NOT NULL" for b in by)).select(*by, *names)
    if robust and not rescan:
        # Moments and residual products are two passes over the same rows.
        frame = materialise(frame)
    table = group(frame, by, moment_sql(names)).filter(F.col("n") > k)
    keys = table.select(*by).schema.fields
    if robust:
        b_names = [f"b_{i}" for i in range(k)]

        def slopes(rec):
            fit = _by_elimination(Moments.of_row(names, rec), y, x)
            return [{**rec, **dict(zip(b_names, np.nan_to_num(fit.beta)))}]

        wide = T.StructType(table.schema.fields + [T.StructField(b, T.DoubleType()) for b in b_names])
        solved = table.mapInPandas(_per_row(slopes, [f.name for f in wide.fields]), wide)
        solved = solved.select(
            *by, F.array(*b_names).alias("beta"), *[F.col(f"m_{i + 1}").alias(f"c_{i}") for i in range(k - 1)]
        )
        rows = frame.join(small_side(solved), by)
        e = f"(`{y}` - beta[0]" + "".join(f" - beta[{i + 1}] * `{c}`" for i, c in enumerate(x)) + ")"
        meat = group(rows, by, _meat_sql(e, [f"(`{c}` - c_{i})" for i, c in enumerate(x)]))
        table = table.join(meat, by)

    def solve(rec):
        m = Moments.of_row(names, rec)
        fit = _by_elimination(m, y, x)
        v = None
        if robust:
            at = [i for i, kept in enumerate(fit.kept) if kept]
            own = [fit.terms[i] for i in at]
            v = sandwich(symmetric(rec, k, "g_")[np.ix_(at, at)], m, own[1:], m.n / (m.n - len(own)))
            v = spread(v, own, fit.terms)
        out = []
        for term, est, se, stat, p in fit.rows(v):
            out.append(
                {
                    **{b: rec[b] for b in by},
                    "term": term,
                    "estimate": est,
                    "std_error": se,
                    "statistic": stat,
                    "p_value": p if digits is None or p is None else round(p, digits),
                    "nobs": m.n,
                }
            )
        return out

    schema = T.StructType(
        keys
        + [T.StructField("term", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("estimate", "std_error", "statistic", "p_value")]
        + [T.StructField("nobs", T.LongType())]
    )
    return table.mapInPandas(_per_row(solve, [f.name for f in schema.fields]), schema)


def grouped_by_triangle(df: DataFrame, by: Sequence[str], y: str, x: Sequence[str]) -> DataFrame:
    """One regression per group from a triangle per group, so rank is found without squaring the condition number.

    One pass over the rows, whatever the sizes of the groups. Aliased regressors have NULL. Groups with no more
    rows than coefficients give no rows.
    """
    x, p = list(x), len(x) + 2

    def add(state: tuple[int, np.ndarray], columns) -> tuple[int, np.ndarray]:
        z = np.column_stack([np.ones(len(columns[y])), *[columns[c] for c in x], columns[y]])
        return state[0] + len(z), np.linalg.qr(np.vstack([state[1], z]), mode="r")

    def merge(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        return a[0] + b[0], np.linalg.qr(np.vstack([a[1], b[1]]), mode="r")

    def finish(state: tuple[int, np.ndarray]) -> list[tuple]:
        n, r = state[0], np.vstack([state[1], np.zeros((p, p))])
        kept = independent(r[:, :-1])
        if n <= len(kept):
            return []
        q, t = np.linalg.qr(r[:, kept])
        beta = np.linalg.solve(t, q.T @ r[:, -1])
        rss = float(((r[:, -1] - r[:, kept] @ beta) ** 2).sum())
        inv = np.linalg.inv(t)
        terms = [INTERCEPT, *x]
        mean = r[:, 0] @ r[:, -1] / (r[:, 0] @ r[:, 0])
        tss = float(((r[:, -1] - mean * r[:, 0]) ** 2).sum())
        fit = Fit("ols", y, [terms[i] for i in kept], beta, rss / (n - len(kept)) * inv @ inv.T, n, n - len(kept), rss, tss)
        return [(*row, n) for row in fit.with_aliased(terms).rows()]

    frame = missing.finite_cases(df, [y, *x]).select(*by, *[F.col(c).cast("double").alias(c) for c in [y, *x]])
    function = Grouped(lambda: (0, np.zeros((0, p))), add, merge, finish)
    return apply_grouped(frame, by, [y, *x], function, TIDY + ", nobs long")
