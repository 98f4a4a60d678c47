"""Residuals on many levels by conjugate gradients against dense least squares and the direct solution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcontrols.operators import embed as E
from textcontrols.operators.level_effects import level_effects, residualize_levels


def _dense(levels, x):
    """Residuals on the dummies of all attributes by a pseudo-inverse."""
    dummies = np.hstack([(np.array(col)[:, None] == np.array(sorted(set(col)))[None, :]).astype(float) for col in levels])
    return x - dummies @ (np.linalg.pinv(dummies) @ x)


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_dense_least_squares(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("textcontrols.operators.level_effects.BROADCAST_BYTES", -1)
    rng = np.random.default_rng(8)
    n = 120
    a, b, c = rng.integers(0, 9, n), rng.integers(0, 6, n), rng.integers(0, 3, n)
    a[:40] = 7  # a level that a third of the rows share
    x = rng.normal(size=(n, 4)) + a[:, None] * 3 - b[:, None] * [1, 2, 3, 4]
    x[:, 3] = a - b  # a dimension that the levels explain
    rows = [(i, int(a[i]), f"b{b[i]}", int(c[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a int, b string, c int, embedding array<double>")
    got = residualize_levels(df, ["a", "b", "c"]).orderBy("id").toPandas()
    assert list(got["id"]) == list(range(n))
    assert np.abs(np.vstack(got["residual"]) - _dense([a, b, c], x)).max() < 1e-8


def test_equals_the_direct_solution(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        "vec_id", "label", "embedding", F.when(F.col("embedding")[0] >= 0, "pos").otherwise("neg").alias("s"))
    want = E.residualize_attributes(e, ["label", "s"]).orderBy("vec_id").toPandas()
    got = residualize_levels(e, ["label", "s"]).orderBy("vec_id").toPandas()
    assert list(want["vec_id"]) == list(got["vec_id"])
    assert np.abs(np.vstack(want["residual"]) - np.vstack(got["residual"])).max() < 1e-8


def test_nulls_single_attribute_repeats_and_empty_tables(spark):
    rows = [(1, "x", [1.0]), (2, "x", [3.0]), (2, "x", [3.0]), (3, None, [5.0]), (4, "y", None), (5, "z", [9.0])]
    df = spark.createDataFrame(rows, "id int, a string, embedding array<double>")
    got = sorted((r.id, round(r.residual[0], 9)) for r in residualize_levels(df, ["a"]).collect())
    assert got == [(1, round(1 - 7 / 3, 9)), (2, round(3 - 7 / 3, 9)), (2, round(3 - 7 / 3, 9)), (5, 0.0)]
    assert residualize_levels(df.where("id > 9"), ["a"]).collect() == []
    with pytest.raises(ValueError):
        level_effects(df, [], "embedding")


def test_many_levels_are_rows_not_literals(spark):
    """2,000 levels of each attribute: the residuals are orthogonal to every level."""
    df = spark.range(60_000).select("id", (F.col("id") % 2_000).alias("a"), F.pmod(F.xxhash64("id"), F.lit(2_000)).alias("b"),
                                    F.array(F.sin("id"), F.cos(F.col("id") * 0.7)).alias("embedding"))
    out = residualize_levels(df, ["a", "b"], tolerance=1e-8)
    for at in ("a", "b"):
        sums = out.groupBy(at).agg(F.sum(F.col("residual")[0]).alias("u"), F.sum(F.col("residual")[1]).alias("v"))
        assert sums.agg(F.max(F.greatest(F.abs("u"), F.abs("v")))).first()[0] < 1e-5
