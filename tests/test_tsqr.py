"""QR factors by a tree: small singular values, shapes and empty inputs."""

import numpy as np
import pytest

from textcontrols.operators import embed as E
from textcontrols.operators.tsqr import factor_to_numpy, singular_vectors, triangular_factor


def _table(spark, x, parts):
    return spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(parts)


@pytest.mark.parametrize("parts,fan_in", [(1, 2), (3, 2), (23, 4), (40, 16)])
def test_small_singular_values_keep_their_digits(spark, parts, fan_in):
    rng = np.random.default_rng(2)
    u, _ = np.linalg.qr(rng.normal(size=(400, 12)))
    w, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    want = np.logspace(0, -10, 12)  # condition number 1e10
    x = (u * want) @ w.T
    df = _table(spark, x, parts)
    sigma, v = singular_vectors(df, "v", fan_in)
    assert np.allclose(sigma, want, rtol=1e-4, atol=0) and np.allclose(sigma[:9], want[:9], rtol=1e-7, atol=0)
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ v, axis=0), sigma, rtol=1e-4, atol=0)
    gram, _ = E.svd_from_gram(E.gram_to_numpy(E.gram_rows(df, "v")))
    assert not np.allclose(gram, want, rtol=1e-2, atol=0)  # what the squares lose


def test_factor_reproduces_products(spark):
    x = np.random.default_rng(4).normal(size=(37, 6))
    r = factor_to_numpy(triangular_factor(_table(spark, x, 9), "v", 3))
    assert r.shape == (6, 6) and np.allclose(np.tril(r, -1), 0) and np.allclose(r.T @ r, x.T @ x)


def test_fewer_rows_than_dimensions_ties_nulls_and_empty_tables(spark):
    x = np.ones((3, 5))
    sigma, v = singular_vectors(_table(spark, x, 2), "v")
    assert np.allclose(sigma, [np.sqrt(15), 0, 0, 0, 0]) and v.shape == (5, 5) and (v[:, 0] > 0).all()
    df = spark.createDataFrame([(None,), ([3.0, 4.0],), (None,)], "v array<double>")
    assert np.allclose(singular_vectors(df, "v")[0], [5, 0])
    sigma, v = singular_vectors(df.where("v is null"), "v")
    assert sigma.size == 0 and v.size == 0
    with pytest.raises(Exception, match="unequal lengths"):
        singular_vectors(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1), "v")
