"""Descriptive operators on literal inputs."""

import math

import numpy as np

from textcontrols.operators import describe as D


def test_value_counts_crosstab_levels(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "c string, d string")
    vc = {(r.attribute, r.level): r.n for r in D.value_counts(df, ["c", "d"]).collect()}
    assert vc == {("c", "a"): 2, ("c", "b"): 1, ("c", None): 1, ("d", "x"): 3, ("d", "y"): 1}
    ct = {r.c: (r.n_x, r.n_y) for r in D.crosstab(df, "c", "d", ["x", "y"]).collect()}
    assert ct["b"] == (1, 0) and ct["a"] == (1, 1)  # empty cell is 0, not null
    one = {r.c: (r.n_x, r.n_other) for r in D.crosstab(df, "c", "d", ["x"]).collect()}
    assert one["a"] == (1, 1) and one["b"] == (1, 0)  # what isn't listed is counted
    lv = {(r.attribute, r.level, r.n_levels) for r in D.distinct_levels(df, ["c", "d"]).collect()}
    assert lv == {("c", "a", 2), ("c", "b", 2), ("d", "x", 2), ("d", "y", 2)}


def test_condition_counts_roles_and_null(spark):
    df = spark.createDataFrame([("g", "BaseA"), ("g", "ShortA"), ("g", "ShortA"), ("g", None), ("g", "LongA"), ("g", "MidA")],
                               "g string, c string")
    r = D.condition_counts(df, "g", "c").collect()[0]
    assert (r.n_base, r.n_short, r.n_long, r.n_other, r.n_total) == (1, 2, 1, 1, 5)


def test_correlations_and_partial(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=300)
    x = z + rng.normal(size=300)
    y = 2 * z + rng.normal(size=300)
    df = spark.createDataFrame([("k", float(a), float(b), float(c)) for a, b, c in zip(x, y, z)],
                               "k string, x double, y double, z double")
    r = D.correlations(df, ["k"], [("x", "y")]).collect()[0].r
    assert abs(r - np.corrcoef(x, y)[0, 1]) < 1e-12
    pr = D.partial_correlations(df, ["k"], ["x"], "y", "z").collect()[0].partial_r
    # residual correlation after regressing both on z
    rx = x - np.polyval(np.polyfit(z, x, 1), z)
    ry = y - np.polyval(np.polyfit(z, y, 1), z)
    assert abs(pr - np.corrcoef(rx, ry)[0, 1]) < 1e-9


def test_column_summary_sample_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    rows = {r.column: r for r in D.column_summary(df, ["a", "b"], report=1).collect()}
    assert list(rows) == ["a"] and rows["a"].n_not_reported == 1
    assert abs(rows["a"].std - math.sqrt(7 / 3)) < 1e-12
