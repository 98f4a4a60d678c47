"""Distributed convergence measures against the one-task form, and order statistics with ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcontrols.functions.stats import normal_quantile
from textcontrols.operators._util import average_ranks
from textcontrols.operators.draws import draw_quantiles, rank_diagnostics
from textcontrols.operators.rank_draws import rank_ess, rank_rhat


def chains():
    rng, rows = np.random.default_rng(2), []
    for c, n in enumerate((301, 300, 7, 2, 1)):  # unequal, odd, too short for a half
        ar = np.zeros(n)
        for t, e in enumerate(rng.normal(size=n)):
            ar[t] = (0.95 * ar[t - 1] if t else 0) + e
        rows += [("slow", c, 3 * t, float(v)) for t, v in enumerate(ar)]
        rows += [("ties", c, t, float(v)) for t, v in enumerate(rng.integers(0, 3, n))]
        rows += [("mostly", c, t, 0.0 if t % 10 else float(rng.normal())) for t in range(n)]
        rows += [("anti", c, t, float((-1) ** t * abs(e) + 0.2 * e)) for t, e in enumerate(rng.normal(size=n))]
        rows += [("flat", c, t, 5.0) for t in range(n)]
    return rows + [("alone", 0, 1, 2.5)]


def test_equal_to_the_one_task_form(spark):
    df = spark.createDataFrame(chains(), "p string, chain int, draw int, value double").repartition(5)
    want = {r.p: r for r in rank_diagnostics(df, ["p"]).collect()}
    rhat = {r.p: r for r in rank_rhat(df, ["p"]).collect()}
    ess = {r.p: r for r in rank_ess(df, ["p"], size=16, first_lags=8).collect()}  # many blocks and ranges of lags
    assert set(want) == set(rhat) == set(ess)
    for p, w in want.items():
        assert (rhat[p].n_chains, rhat[p].n_draws) == (ess[p].n_chains, ess[p].n_draws) == (w.n_chains, w.n_draws)
        for got, known in ((rhat[p].rhat, w.rhat), (ess[p].ess_bulk, w.ess_bulk)):
            assert got is None if known is None else got == pytest.approx(known, rel=1e-9), p


def test_missing_draws_and_no_rows(spark):
    rows = [("a", 0, t, float(t % 7)) for t in range(40)] + [("a", 1, t, None if t % 3 else float("nan")) for t in range(9)]
    df = spark.createDataFrame(rows, "p string, chain int, draw int, value double")
    there = df.where("value is not null and not isnan(value)")
    assert rank_ess(df, ["p"]).collect() == rank_ess(there, ["p"]).collect()
    assert rank_rhat(df, ["p"]).collect() == rank_rhat(there, ["p"]).collect()
    assert rank_ess(df.limit(0), ["p"]).collect() == rank_rhat(df.limit(0), ["p"]).collect() == []


def test_normal_quantile(spark):
    from statistics import NormalDist
    ps = [1e-300, 1e-40, 1e-12, 0.01, 0.074, 0.075, 0.076, 0.3, 0.5, 0.9, 0.925, 0.99, 1 - 1e-12]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert all(g == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-15) for g, p in zip(got, ps))


def test_ranks_of_ties_across_slices(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 900), np.where(rng.random(900) < 0.8, 1.0, rng.normal(size=900))))]
    got = {r.i: r["rank"] for r in average_ranks(spark.createDataFrame(rows, "g int, v double, i int"), "g", "v", "i").collect()}
    for g, v, i in rows:
        own = [x for h, x, _ in rows if h == g]
        assert got[i] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2


@pytest.mark.parametrize("share", [0.9, 1.0])
def test_quantiles_of_a_value_that_most_rows_share(spark, share):
    """Exact, and no task reads more than twice the median."""
    n = 20_000
    rng = np.random.default_rng(6)
    v = np.where(rng.random(n) < share, 3.25, rng.normal(size=n) * 10)
    df = spark.createDataFrame([("k", float(x)) for x in v], "k string, v double").repartition(4)
    r = draw_quantiles(df, ["k"], "v").collect()[0]
    assert r.n == n and math.isclose(r["mean"], v.mean())
    assert [r.q025, r.q500, r.q975] == pytest.approx(np.quantile(v, [0.025, 0.5, 0.975]).tolist(), abs=1e-12)
    from textcontrols.operators._util import slices
    sizes = [x["count"] for x in slices(df.withColumn("i", F.monotonically_increasing_id()), ["k", "v", "i"]).groupBy("_pid").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]
