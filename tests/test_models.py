"""Models against NumPy: OLS, cell means, pooled effect, exact LOO equals refits, quantiles."""

import math

import numpy as np
from pyspark.sql import functions as F

from textcontrols.operators import regress as R
from textcontrols.operators.draws import draw_quantiles
from textcontrols.functions.stats import t_quantile

RNG = np.random.default_rng(7)


def _frame(spark, n=40):
    x1, x2 = RNG.normal(size=n), RNG.normal(size=n)
    y = 1.5 + 2.0 * x1 - 0.5 * x2 + RNG.normal(scale=0.7, size=n)
    g = ["a"] * n
    rows = [(g[i], float(y[i]), float(x1[i]), float(x2[i])) for i in range(n)]
    return spark.createDataFrame(rows, "g string, y double, x1 double, x2 double"), y, x1, x2


def test_ols_two_controls_matches_numpy(spark):
    df, y, x1, x2 = _frame(spark)
    out = {r.parameter: r for r in R.fit_ols(df, ["g"], "y", ["x1", "x2"]).collect()}
    X = np.column_stack([np.ones_like(x1), x1, x2])
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    rss = float(((y - X @ b) ** 2).sum())
    nu = len(y) - 3
    cov = rss / nu * np.linalg.inv(X.T @ X)
    for j, name in enumerate(["Intercept", "x1", "x2"]):
        assert abs(out[name].estimate - b[j]) < 1e-10
        assert abs(out[name].est_error - math.sqrt(cov[j, j] * nu / (nu - 2))) < 1e-10


def test_loo_equals_refits(spark):
    df, y, x1, x2 = _frame(spark)
    mom = R.group_moments(df, ["g"], ["y", "x1", "x2"])
    wide = R.ols_wide(mom, ["g"], "y", ["x1", "x2"])
    ours = R.looic(R.loo_pointwise(df, wide, ["g"], "y", ["x1", "x2"]), ["g"]).collect()[0]["looic"]
    X = np.column_stack([np.ones_like(x1), x1, x2])
    total = 0.0
    for i in range(len(y)):
        m = np.arange(len(y)) != i
        b, *_ = np.linalg.lstsq(X[m], y[m], rcond=None)
        nu = m.sum() - 3
        s2 = float(((y[m] - X[m] @ b) ** 2).sum()) / nu
        scale2 = s2 * (1 + X[i] @ np.linalg.inv(X[m].T @ X[m]) @ X[i])
        r = y[i] - X[i] @ b
        total += (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * scale2)
                  - (nu + 1) / 2 * math.log1p(r * r / (nu * scale2)))
    assert abs(ours - (-2 * total)) < 1e-6


def test_cell_means_pooled_sigma_and_singleton(spark):
    rows = [("e", "A", 1.0), ("e", "A", 3.0), ("e", "B", 10.0), ("e", "B", 14.0), ("e", "B", 12.0), ("e", "C", 5.0),
            ("e", None, 99.0)]
    df = spark.createDataFrame(rows, "e string, c string, y double")
    cells = R.cell_moments(df, ["e"], "c", ["y"])
    cmw = {r.c: r for r in R.cell_mean_wide(cells, ["e"], "c", "y").collect()}
    # pooled s2 = (2 + 8 + 0) / (6 - 3); the null-level row is not in the model
    assert abs(cmw["A"].s2 - 10.0 / 3) < 1e-12 and cmw["A"].nu == 3
    loo = R.looic(R.loo_pointwise_cells(df, R.cell_mean_wide(cells, ["e"], "c", "y"), ["e"], "c", "y"), ["e"])
    assert loo.collect()[0]["n_undefined"] == 1  # the singleton cell C


def test_pooled_effect_weights(spark):
    cm = spark.createDataFrame([("e", "B", 125, 1.324, 1.0, 350), ("e", "S", 118, 0.155, 1.0, 350),
                                ("e", "L", 110, 1.293, 1.0, 350)], "e string, c string, n long, mean double, s2 double, nu long")
    est = R.pooled_effect(cm, ["e"]).collect()[0]["estimate"]
    assert abs(est - 0.92357) < 1e-5


def test_t_quantile(spark):
    # printed tables of the 97.5 % points
    want = {1: 12.7062, 2: 4.30265, 3: 3.18245, 5: 2.57058, 10: 2.22814, 30: 2.04227, 100: 1.98397, 101: 1.98373, 200: 1.97190}
    df = spark.createDataFrame([(n,) for n in [*want, 0]], "nu int")
    q = [r[0] for r in df.select(t_quantile("nu")).collect()]
    assert all(abs(a - b) < 6e-5 for a, b in zip(q, want.values())) and q[-1] is None


def test_complete_cases_and_rank(spark):
    rows = [("g", float(i * i % 13), None if i % 4 == 0 else float(i), float("nan") if i == 7 else float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, y double, a double, b double")
    kept = [r for r in rows if r[2] is not None and r[3] == r[3]]
    out = {r.parameter: r for r in R.fit_ols(df, ["g"], "y", ["a", "b"]).collect()}
    X = np.column_stack([np.ones(len(kept)), [r[2] for r in kept], [r[3] for r in kept]])
    y = np.array([r[1] for r in kept])
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert out["a"].n == len(kept) and out["a"].nu == len(kept) - 3
    assert all(abs(out[k].estimate - v) < 1e-9 for k, v in zip(["Intercept", "a", "b"], b))
    twin = df.withColumn("c", 3 * F.col("a") + 0.1)
    for xs in (["a", "c"], ["a", "b", "c"]):
        assert {(r.estimate, r.est_error, r.q_lo) for r in R.fit_ols(twin, ["g"], "y", xs).collect()} == {(None, None, None)}


def test_unequal_chains_and_antithetic_draws(spark):
    from textcontrols.operators.draws import batch_means_ess, rank_diagnostics, split_rhat
    rng = np.random.default_rng(5)
    rows = [("short", c, 10 * t, float(v)) for c, n in enumerate((1500, 1500, 1500, 100)) for t, v in enumerate(rng.normal(size=n))]
    for c in range(4):
        e = rng.normal(size=1500)
        rows += [("anti", c, 10 * t, float((-1) ** t * abs(v) + 0.2 * v)) for t, v in enumerate(e)]
    df = spark.createDataFrame(rows, "p string, chain int, draw int, value double")
    out = {r.p: r for r in rank_diagnostics(df, ["p"]).collect()}
    assert out["short"].n_draws == 4600 and abs(out["short"].rhat - 1) < 0.02 and out["short"].ess_bulk > 3500
    assert out["anti"].ess_bulk > 6000
    assert {r.p: r for r in batch_means_ess(df, ["p"]).collect()}["anti"].ess > 6000
    assert {r.p: r.n_half for r in split_rhat(df, ["p"]).collect()} == {"short": 8, "anti": 8}


def test_draw_quantiles_type7(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 4.0, 8.0, 16.0, 31.0]], "v double").withColumn("k", F.lit(1))
    r = draw_quantiles(df, ["k"], "v").collect()[0]
    assert (r.q025, r.q500, r.q975) == (1.125, 6.0, 29.125)


def test_lgamma_column(spark):
    df = spark.createDataFrame([(x,) for x in [0.5, 1.0, 2.5, 7.0, 150.5, 30000.0]], "x double")
    got = [r[0] for r in df.select(R.lgamma_col(F.col("x"))).collect()]
    for x, g in zip([0.5, 1.0, 2.5, 7.0, 150.5, 30000.0], got):
        assert abs(g - math.lgamma(x)) < 1e-9 * max(1.0, abs(math.lgamma(x)))


def test_ols_general_matches_closed_form_and_numpy(spark):
    n = 60
    X = RNG.normal(size=(n, 4))
    y = 0.5 + X @ np.array([1.0, -2.0, 0.3, 0.0]) + RNG.normal(scale=0.5, size=n)
    rows = [("g", float(y[i]), *map(float, X[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, y double, a double, b double, c double, d double")
    # p = 3 through the general path equals the closed form
    mom = R.group_moments(df, ["g"], ["y", "a", "b"])
    gen = {r.parameter: r.estimate for r in R.ols_general(mom, ["g"], "y", ["a", "b"]).collect()}
    closed = {r.parameter: r.estimate for r in R.fit_ols(df, ["g"], "y", ["a", "b"]).collect()}
    assert all(abs(gen[k] - closed[k]) < 1e-9 for k in closed)
    out = {r.parameter: r for r in R.fit_ols(df, ["g"], "y", ["a", "b", "c", "d"]).collect()}
    A = np.column_stack([np.ones(n), X])
    b, *_ = np.linalg.lstsq(A, y, rcond=None)
    nu = n - 5
    cov = float(((y - A @ b) ** 2).sum()) / nu * np.linalg.inv(A.T @ A)
    for j, name in enumerate(["Intercept", "a", "b", "c", "d"]):
        assert abs(out[name].estimate - b[j]) < 1e-9
        assert abs(out[name].est_error - math.sqrt(cov[j, j] * nu / (nu - 2))) < 1e-9


def test_rank_diagnostics_iid_and_autocorrelated(spark):
    from textcontrols.operators.draws import rank_diagnostics
    rng = np.random.default_rng(3)
    rows = []
    for c in range(4):
        e = rng.normal(size=2000)
        ar = np.zeros(2000)
        for t in range(1, 2000):
            ar[t] = 0.9 * ar[t - 1] + e[t]
        iid = rng.normal(size=2000)
        rows += [("iid", c, t, float(iid[t])) for t in range(2000)]
        rows += [("ar", c, t, float(ar[t])) for t in range(2000)]
    df = spark.createDataFrame(rows, "p string, chain int, draw int, value double")
    out = {r.p: r for r in rank_diagnostics(df, ["p"]).collect()}
    assert abs(out["iid"].rhat - 1) < 0.01 and 6500 < out["iid"].ess_bulk < 9500
    # AR(1), phi = 0.9: ESS close to n (1 - phi) / (1 + phi) = 8000 / 19
    assert 250 < out["ar"].ess_bulk < 650 and out["ar"].rhat < 1.05
