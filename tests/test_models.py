"""Estimators against plain NumPy formulas and algebraic identities."""

import math

import numpy as np
import pandas as pd
import pytest

from panelweave.functions import distributions as dist
from panelweave.models import diagnostics, gmm as gm, iv, linear, panel_models as pm, report
from panelweave.models.moments import gram
from panelweave.operators.panel import Panel
from pyspark.sql import functions as F


def simulate(n=60, periods=8, seed=1, gaps=True, rho=0.5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, y = rng.normal(), rng.normal()
        for t in range(periods):
            z1, z2, e = rng.normal(), rng.normal(), rng.normal()
            x = 0.7 * z1 - 0.4 * z2 + 0.5 * e + 0.3 * a + rng.normal()
            w = rng.normal() + 0.2 * t
            y = rho * y + 1.0 * x - 0.5 * w + a + 0.1 * t + e
            if not gaps or rng.random() > 0.15:
                rows.append((i, 2000 + t, y, x, w, z1, z2))
    return pd.DataFrame(rows, columns=["id", "t", "y", "x", "w", "z1", "z2"])


@pytest.fixture(scope="module")
def data():
    return simulate()


@pytest.fixture(scope="module")
def panel(spark, data):
    return Panel(spark.createDataFrame(data).repartition(4), "id", "t")


def np_ols(y, x):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b, e


def close(a, b, tol=1e-8):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=tol, atol=tol)


def test_ols_and_hc1(panel, data):
    fit, v = linear.ols_robust(panel.df, "y", ["x", "w"])
    x = np.column_stack([np.ones(len(data)), data.x, data.w])
    b, e = np_ols(data.y.values, x)
    inv = np.linalg.inv(x.T @ x)
    n, k = x.shape
    close(fit.beta, b)
    close(fit.vcov, e @ e / (n - k) * inv)
    close(v, n / (n - k) * inv @ (x.T * e**2 @ x) @ inv)
    s = fit.summary()
    tss = ((data.y - data.y.mean()) ** 2).sum()
    close(s["r_squared"], 1 - e @ e / tss)
    close(s["f_statistic"], (tss - e @ e) / 2 / (e @ e / (n - k)))
    q = linear.residual_quantiles(fit.with_residuals(panel.df)).first()
    close(list(q), np.quantile(e, [0, 0.25, 0.5, 0.75, 1]))


def test_grouped_ols_matches_single_fits(spark, data):
    df = spark.createDataFrame(data.assign(g=data.id % 3)).union(spark.createDataFrame(data.head(2).assign(g=99)))
    out = {(r["g"], r["term"]): r for r in linear.grouped_ols(df, ["g"], "y", ["x", "w"], digits=None).collect()}
    assert {g for g, _ in out} == {0, 1, 2}  # two rows are too few for three coefficients
    for g in range(3):
        fit, v = linear.ols_robust(df.filter(F.col("g") == g), "y", ["x", "w"])
        for term, est, se, stat, p in fit.rows(v):
            r = out[(g, term)]
            close([r["estimate"], r["std_error"], r["statistic"], r["p_value"]], [est, se, stat, p])


def test_first_difference_modes(panel, data):
    d = data.sort_values(["id", "t"])
    diff = d.groupby("id")[["y", "x", "t"]].diff().dropna()
    for mode, part in (("row", diff), ("calendar", diff[diff.t == 1])):
        b, _ = np_ols(part.y.values, np.column_stack([np.ones(len(part)), part.x]))
        close(pm.first_difference(panel, "y", ["x"], mode).beta, b)


def dummies(data, time):
    cols = [pd.get_dummies(data.id).values.astype(float)]
    if time:
        cols.append(pd.get_dummies(data.t).values[:, 1:].astype(float))
    return np.column_stack(cols)


@pytest.mark.parametrize("effect", ["individual", "twoways"])
def test_within_equals_dummy_regression(panel, data, effect):
    w = pm.within(panel, "y", ["x", "w"], effect)
    x = np.column_stack([data.x, data.w, dummies(data, effect == "twoways")])
    b, e = np_ols(data.y.values, x)
    close(w.fit.beta, b[:2])
    assert w.fit.df_resid == len(data) - x.shape[1]
    close(w.fit.vcov, (e @ e / (len(data) - x.shape[1]) * np.linalg.inv(x.T @ x))[:2, :2])
    # Clustered by entity on the transformed regressors.
    d = dummies(data, effect == "twoways")
    xt = data[["x", "w"]].values - d @ np.linalg.lstsq(d, data[["x", "w"]].values, rcond=None)[0]
    scores = pd.DataFrame(xt * e[:, None]).groupby(data.id.values).sum().values
    bread = np.linalg.inv(xt.T @ xt)
    n = len(data)
    close(w.cluster_vcov(), n / (n - 2) * bread @ (scores.T @ scores) @ bread)
    res = w.residuals().toPandas().sort_values(["id", "t"])
    close(res.residual, e[np.lexsort((data.t, data.id))])
    assert abs(res.groupby("id").residual.sum()).max() < 1e-8


def test_balanced_two_way_is_double_demeaning(spark):
    d = simulate(5, 4, 3, gaps=False)
    m = lambda c: d[c] - d.groupby("id")[c].transform("mean") - d.groupby("t")[c].transform("mean") + d[c].mean()
    fit = pm.within(Panel(spark.createDataFrame(d), "id", "t"), "y", ["x"], "twoways").fit
    close(fit.beta, [(m("x") * m("y")).sum() / (m("x") ** 2).sum()])


def test_unknown_effect_is_rejected(panel):
    with pytest.raises(ValueError):
        pm.within(panel, "y", ["x"], "two")


def np_random(data, y, x):
    """Baltagi-Chang components by explicit matrices."""
    d = pd.get_dummies(data.id).values.astype(float)
    n, m, k = len(data), d.shape[1], len(x)
    p = d @ np.linalg.inv(d.T @ d) @ d.T
    yy, xx = data[y].values, np.column_stack([np.ones(n), data[x]])
    q = np.eye(n) - p
    xw = q @ xx[:, 1:]
    bw = np.linalg.lstsq(xw, q @ yy, rcond=None)[0]
    s2e = np.sum((q @ yy - xw @ bw) ** 2) / (n - m - k)
    bb = np.linalg.solve(xx.T @ p @ xx, xx.T @ p @ yy)
    r = p @ (yy - xx @ bb)
    trace = np.trace(np.linalg.inv(xx.T @ p @ xx) @ xx.T @ d @ d.T @ xx)
    s2u = max((r @ r - (m - k - 1) * s2e) / (n - trace), 0)
    omega = s2e * np.eye(n) + s2u * d @ d.T
    oi = np.linalg.inv(omega)
    return np.linalg.solve(xx.T @ oi @ xx, xx.T @ oi @ yy), s2e, s2u, np.linalg.inv(xx.T @ oi @ xx)


def test_random_effects_equals_gls(panel, data):
    re = pm.random_effects(panel, "y", ["x", "w"])
    b, s2e, s2u, _ = np_random(data, "y", ["x", "w"])
    close([re.sigma2_e, re.sigma2_u], [s2e, s2u])
    close(re.fit.beta, b)
    res = re.transformed_residuals(panel).toPandas()
    close((res.residual**2).sum(), re.fit.rss)


def test_durbin_watson(panel):
    stat, re = diagnostics.durbin_watson(panel, "y", ["x", "w"])
    res = re.transformed_residuals(panel).toPandas().sort_values(["id", "t"])
    d = res.groupby("id").residual.diff().dropna()
    close(stat, (d**2).sum() / (res.residual**2).sum())
    pooled, _ = diagnostics.durbin_watson(panel, "y", ["x", "w"], across_entities=True)
    close(pooled, (res.residual.diff().dropna() ** 2).sum() / (res.residual**2).sum())


def np_2sls(y, x, z):
    p = z @ np.linalg.inv(z.T @ z) @ z.T
    b = np.linalg.solve(x.T @ p @ x, x.T @ p @ y)
    return b, y - x @ b, np.linalg.inv(x.T @ p @ x)


def test_two_stage_and_diagnostics(panel, data):
    one = np.ones(len(data))
    x, z = np.column_stack([one, data.x, data.w]), np.column_stack([one, data.w, data.z1, data.z2])
    b, e, inv = np_2sls(data.y.values, x, z)
    fit = iv.iv(panel.df, "y", ["x"], ["w"], ["z1", "z2"])
    n = len(data)
    close(fit.beta, b)
    close(fit.vcov, e @ e / (n - 3) * inv)
    tests = {t[0]: t for t in fit.extra["diagnostics"]}
    rss = lambda a, m: np.sum(np_ols(a, m)[1] ** 2)
    xv = data.x.values
    r0, r1 = rss(xv, np.column_stack([one, data.w])), rss(xv, z)
    close(tests["weak_instruments"][3], (r0 - r1) / 2 / (r1 / (n - 4)))
    v = np_ols(xv, z)[1]
    r0, r1 = rss(data.y.values, x), rss(data.y.values, np.column_stack([x, v]))
    close(tests["wu_hausman"][3], (r0 - r1) / (r1 / (n - 4)))
    close(tests["sargan"][3], n * (1 - rss(e, z) / (e @ e)))


def test_iv_with_own_instrument_is_ols(panel):
    a, b = iv.iv(panel.df, "y", ["x"], ["w"], ["x"]), linear.ols(panel.df, "y", ["x", "w"])
    close(a.beta, b.beta)
    close(a.vcov, b.vcov)
    assert a.extra["diagnostics"][-1][1] == 0.0
    with pytest.raises(ValueError):
        iv.iv(panel.df, "y", ["x", "w"], [], ["z1"])


@pytest.mark.parametrize("effect", ["individual", "twoways"])
def test_iv_within_equals_dummies(panel, data, effect):
    d = dummies(data, effect == "twoways")
    x, z = np.column_stack([data.x, data.w, d]), np.column_stack([data.w, data.z1, data.z2, d])
    b, e, inv = np_2sls(data.y.values, x, z)
    fit = iv.iv_within(panel, "y", ["x"], ["w"], ["z1", "z2"], effect)
    close(fit.beta, b[:2])
    close(fit.vcov, (e @ e / (len(data) - x.shape[1]) * inv)[:2, :2])


def test_gram_paths_agree(panel):
    cols = ["y", "x", "w"]
    wide = [f"z1 * {i} + z2" for i in range(150)]
    big = gram(panel.df, (cols, wide))
    close(big[:, :20], gram(panel.df, (cols, wide[:20])))


# GMM by dense matrices, one entity at a time. ----------------------------------------------------


def np_gmm(data, y, x, lags, ivs, system, collapse, steps, twoways=False, block=False):
    """x and ivs are column names (current values); the first regressor is the lagged outcome."""
    t0, t1 = int(data.t.min()), int(data.t.max())
    years = range(t0, t1 + 1)
    a, b = lags[0], min(lags[1], t1 - t0)
    stack = []
    for _, g in data.groupby("id"):
        v = {c: dict(zip(g.t, g[c])) for c in [y, *x, *ivs]}
        get = lambda c, t: v[c].get(t, np.nan)
        eqs = []
        for t in years:
            for kind in ("d", "l") if system else ("d",):
                lev = lambda s: np.array([get(y, s), get(y, s - 1), *[get(c, s) for c in x]])
                ivr = lambda s: np.array([get(c, s) for c in ivs])
                row, z = (lev(t) - lev(t - 1), ivr(t) - ivr(t - 1)) if kind == "d" else (lev(t), ivr(t))
                if not (np.isfinite(row).all() and np.isfinite(z).all()):
                    continue
                names = {}
                if kind == "d":
                    for k in range(a, b + 1):
                        val = get(y, t - k)
                        names[("g", k) if collapse else ("g", t, k)] = 0.0 if np.isnan(val) else val
                else:
                    val = get(y, t - a + 1) - get(y, t - a)
                    names[("s",) if collapse else ("s", t)] = 0.0 if np.isnan(val) else val
                for c, val in zip(ivs, z):
                    names[("iv", c)] = val
                tail = []
                if twoways:
                    for p in years:
                        if p < t0 + (1 if system else 2):
                            continue
                        val = float(t == p) - (float(t - 1 == p) if system else 0.0) if kind == "d" else float(t == p)
                        tail.append(val)
                        names[("p", p)] = val
                eqs.append((kind, t, np.append(row, tail), names))
        stack.append(eqs)
    keys = sorted({k for e in stack for q in e for k in q[3]}, key=repr)
    ents = []
    for eqs in stack:
        if not eqs:
            continue
        z = np.array([[q[3].get(k, 0.0) for k in keys] for q in eqs])
        r = np.array([q[2] for q in eqs])
        h = np.zeros((len(eqs), len(eqs)))
        for i, (k1, s, *_1) in enumerate(eqs):
            for j, (k2, t, *_2) in enumerate(eqs):
                if k1 == k2 == "d":
                    h[i, j] = {0: 2.0, 1: -1.0}.get(abs(s - t), 0.0)
                elif k1 == k2 == "l":
                    h[i, j] = float(s == t)
                elif not block:
                    d, l = (s, t) if k1 == "d" else (t, s)
                    h[i, j] = {0: 1.0, 1: -1.0}.get(d - l, 0.0)
        ents.append((z, r[:, 0], r[:, 1:], h, eqs))
    zx, zy = sum(z.T @ x for z, _, x, _, _ in ents), sum(z.T @ y for z, y, _, _, _ in ents)
    w1 = np.linalg.pinv(sum(z.T @ h @ z for z, _, _, h, _ in ents), rcond=1e-10, hermitian=True)
    step = lambda w: (np.linalg.pinv(zx.T @ w @ zx), np.linalg.pinv(zx.T @ w @ zx) @ zx.T @ w)
    _, gain1 = step(w1)
    b1 = gain1 @ zy
    score = [z.T @ (y - x @ b1) for z, y, x, _, _ in ents]
    omega = sum(np.outer(s, s) for s in score)
    v1 = gain1 @ omega @ gain1.T
    w2 = np.linalg.pinv(omega, rcond=1e-10, hermitian=True)
    bread2, gain2 = step(w2)
    beta, vcov, gain = (b1, v1, gain1) if steps == 1 else (gain2 @ zy, bread2, gain2)
    if steps == 2:
        m = zy - zx @ beta
        d = np.zeros((len(beta), len(beta)))
        for k in range(len(beta)):
            om = -sum(np.outer(z.T @ x[:, k], s) + np.outer(s, z.T @ x[:, k]) for (z, _, x, _, _), s in zip(ents, score))
            d[:, k] = -gain2 @ om @ w2 @ m
        vcov = bread2 + d @ bread2 + bread2 @ d.T + d @ v1 @ d.T
    m = zy - zx @ beta
    ar = {}
    for order in (1, 2):
        tot = sq = 0.0
        aa, zc = np.zeros(len(beta)), np.zeros(len(keys))
        for z, yv, xv, _, eqs in ents:
            u = yv - xv @ beta
            ud = {t: u[i] for i, (k, t, *_r) in enumerate(eqs) if k == "d"}
            lagged = np.array([ud.get(t - order, 0.0) if k == "d" else 0.0 for k, t, *_r in eqs])
            c = lagged @ u
            tot, sq, aa, zc = tot + c, sq + c * c, aa + lagged @ xv, zc + c * (z.T @ u)
        ar[order] = tot / math.sqrt(sq - 2 * aa @ gain @ zc + aa @ vcov @ aa)
    return beta, vcov, m @ w2 @ m, ar


CASES = [
    dict(lags=(2, 3), ivs=["x", "w"], system=False, collapse=True, steps=1),
    dict(lags=(2, 3), ivs=["w", "z1", "z2"], system=False, collapse=False, steps=2),
    dict(lags=(3, 4), ivs=["x", "w"], system=False, collapse=True, steps=2),
    dict(lags=(2, 20), ivs=["x", "w"], system=True, collapse=True, steps=2),
    dict(lags=(2, 4), ivs=["x", "w"], system=True, collapse=False, steps=1, twoways=True),
    dict(lags=(2, 3), ivs=["x", "w"], system=False, collapse=True, steps=1, twoways=True),
    dict(lags=(2, 5), ivs=["x", "w"], system=True, collapse=True, steps=1, block=True),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: "-".join(f"{k}{v}" for k, v in c.items() if k != "ivs"))
def test_gmm_equals_dense_matrices(panel, data, case):
    beta, vcov, j, ar = np_gmm(data, "y", ["x", "w"], **case)
    fit = gm.gmm(
        panel, "y", ["x", "w"], case["lags"], case["ivs"], "ld" if case["system"] else "d", case["steps"], case["collapse"],
        "twoways" if case.get("twoways") else "individual", first_step="block" if case.get("block") else "full",
    )
    close(fit.fit.beta, beta, 1e-6)
    close(fit.fit.vcov, vcov, 1e-6)
    close(fit.test("sargan")[0], j, 1e-6)
    close([fit.test("ar1")[0], fit.test("ar2")[0]], [ar[1], ar[2]], 1e-6)


def test_gmm_recovers_known_coefficients(spark):
    d = simulate(800, 8, 7)
    p = Panel(spark.createDataFrame(d), "id", "t")
    fit = gm.gmm(p, "y", ["x", "w"], (2, 4), ["w", "z1", "z2"], "d", 2, True, "twoways").fit
    close(fit.beta[:3], [0.5, 1.0, -0.5], 0.15)


def test_gmm_treats_nan_and_infinity_as_missing(spark, data):
    bad = data.copy()
    bad.loc[bad.index[5], "y"], bad.loc[bad.index[40], "x"] = np.nan, np.inf
    gone = bad.replace(np.inf, np.nan).astype(object).where(lambda d: d.notna(), None)
    schema = "id long, t long, y double, x double, w double, z1 double, z2 double"
    fits = [
        gm.gmm(Panel(spark.createDataFrame([tuple(r) for r in d.itertuples(index=False)], schema), "id", "t"), "y", ["x"], (2, 3), ar_orders=()).fit
        for d in (bad.astype(object), gone)
    ]
    assert np.isfinite(fits[0].beta).all() and fits[0].nobs < len(data)
    close(fits[0].beta, fits[1].beta)


def test_gmm_rejects_unknown_options(panel):
    for kw in (dict(transformation="x"), dict(steps=3), dict(effect="two")):
        with pytest.raises(ValueError):
            gm.gmm(panel, "y", **kw)


def np_adf(v, pmax):
    best = None
    dv = np.diff(v)
    for p in range(pmax + 1):
        n = len(dv) - p
        k = p + 2
        if n <= k:
            continue
        y = dv[p:]
        x = np.column_stack([v[p:-1]] + [dv[p - i : len(dv) - i] for i in range(1, p + 1)] + [np.ones(n)])
        b, e = np_ols(y, x)
        sic = np.log(e @ e / n) + k * np.log(n) / n
        se = math.sqrt(e @ e / (n - k) * np.linalg.inv(x.T @ x)[0, 0])
        if best is None or sic < best[0]:
            best = (sic, b[0] / se, p)
    return best


def test_unit_root(spark):
    d = simulate(20, 25, 5, gaps=False)
    p = Panel(spark.createDataFrame(d), "id", "t")
    got = {r["id"]: (r["adf"], r["lags"], r["p_value"]) for r in diagnostics.adf_by_entity(p, "y").collect()}
    total = 0.0
    for i, g in d.groupby("id"):
        _, stat, lags = np_adf(g.sort_values("t").y.values, 4)
        close(got[i][0], stat, 1e-6)
        assert got[i][1] == lags
        total += -2 * math.log(got[i][2])
    out = diagnostics.unit_root_fisher(p, "y")
    close(out["statistic"], total, 1e-6)
    assert out["df"] == 40
    close(diagnostics.adf_p_value(-2.86), 0.05, 0.02)


def test_distributions():
    close(dist.t_two_sided(2.228139, 10), 0.05, 1e-6)
    close(dist.f_upper(4.102821, 2, 10), 0.05, 1e-6)
    close(dist.chi2_upper(18.307038, 10), 0.05, 1e-6)
    close(dist.normal_two_sided(1.959964), 0.05, 1e-6)
    close(dist.t_quantile(0.975, 10), 2.228139, 1e-6)


def test_model_table(spark, panel):
    a, v = linear.ols_robust(panel.df, "y", ["x", "w"])
    b = linear.ols(panel.df, "y", ["x"])
    out = report.model_table(spark, [("full", a, v), ("short", b)], {"fit": ["full", "short"]})
    got = {r["term"]: r.asDict() for r in out.collect()}
    assert got["w"]["fit_short_estimate"] is None
    close(got["x"]["fit_full_se"], math.sqrt(v[1, 1]))
    close(got["x"]["fit_short_estimate"], b.coefficient("x"))


def test_many_entity_lengths(spark):
    """More lengths than any fixed bound: one-way within and random effects against dummy regression."""
    rng = np.random.default_rng(8)
    parts = []
    for i, n in enumerate(range(2, 1105, 1)):
        x = rng.normal(size=n) + i % 5
        parts.append(pd.DataFrame({"id": i, "t": np.arange(n), "x": x, "y": 0.7 * x + i % 7 + rng.normal(size=n)}))
    d = pd.concat(parts)
    p = Panel(spark.createDataFrame(d), "id", "t")
    w = d[["x", "y"]] - d.groupby("id")[["x", "y"]].transform("mean")
    close(pm.within(p, "y", ["x"]).fit.beta[0], (w.x @ w.y) / (w.x @ w.x), 1e-9)
    re = pm.random_effects(p, "y", ["x"])
    assert re.fit.extra["entities"] == 1103 and abs(re.fit.beta[1] - 0.7) < 0.01


def test_two_way_needs_a_key(spark):
    d = simulate(12, 6, 3, gaps=False)
    twice = spark.createDataFrame(pd.concat([d, d.iloc[:5]]))
    with pytest.raises(ValueError):
        pm.within(Panel(twice, "id", "t"), "y", ["x"], effect="twoways")
    with pytest.raises(ValueError):
        gm.gmm(Panel(twice, "id", "t"), "y", ["x"])


def test_fisher_has_no_invented_constant(spark):
    rng = np.random.default_rng(2)
    noise = pd.DataFrame({"id": 0, "t": range(40), "y": rng.normal(size=40) * 1e-3 + np.tile([1.0, -1.0], 20)})
    short = pd.DataFrame({"id": 1, "t": range(2), "y": [1.0, 2.0]})
    out = diagnostics.unit_root_fisher(Panel(spark.createDataFrame(pd.concat([noise, short])), "id", "t"), "y", 0)
    assert out["not_identified"] == 1 and out["beyond_surface"] == 1
    close(out["statistic"], -2 * math.log(diagnostics.adf_p_value(diagnostics.ADF_MIN)), 1e-9)
    assert 0 < diagnostics.adf_p_value(-1e9) < 1e-28


def test_mixture_depends_on_rows_only(spark):
    from panelweave.models.mixture import mixture_classes

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-3, 1, (150, 2)), rng.normal(2, 0.5, (90, 2))])
    frame = spark.createDataFrame(pd.DataFrame({"k": range(240), "a": x[:, 0], "b": x[:, 1]}))
    seen = []
    for n in (1, 3, 8):
        classed, scores = mixture_classes(frame.repartition(n), ["a", "b"], (1, 2))
        seen.append({r["k"]: r["class"] for r in classed.collect()})
        assert min(scores, key=lambda s: s[1])[0] == 2
    assert seen[0] == seen[1] == seen[2]
    assert sum(seen[0][i] == 0 for i in range(150)) > 145 and sum(seen[0][i] == 1 for i in range(150, 240)) > 85


def test_normal_limit_of_t():
    close(dist.t_two_sided(1.959964, 1e13), 0.05, 1e-6)
