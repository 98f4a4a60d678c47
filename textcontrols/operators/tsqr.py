"""Singular values and right singular vectors of a tall table of vectors by a tree of QR factors.

Every input split is reduced to one triangular factor (at most d x d numbers),
``FAN_IN`` factors at a time to the next one, level by level, until one is left.
The squares of the entries never enter, so small singular values keep the digits
that a Gram matrix loses.  A task holds one block of rows, or ``FAN_IN`` factors; only the
last d x d factor reaches the driver.  The number of tasks follows the splits, not the
cores at hand.

Null vectors are left out; an empty table gives no factor (a 0 x 0 matrix).
Vectors of unequal lengths are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.operators._util import stored
from textcontrols.session import send_package

#: Factors that one task of a level reduces to one.
FAN_IN = 16
#: Rows of a block, in multiples of the vectors' length, that are factored at once.
BLOCK = 8

_SCHEMA = "_part long, _at int, row array<double>"


def _upper(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r") if len(x) else x


def _split_factor(batches):
    """Rows of the factor of a split: (its number, place of the row, row)."""
    from pyspark import TaskContext

    held, factor, rows = [], None, 0
    for batch in batches:
        column = batch.column(0).drop_null()
        if not len(column):
            continue
        ends = np.diff(column.offsets.to_numpy())
        d = int(ends[0])
        if (ends != d).any() or (factor is not None and factor.shape[1] != d) or (held and held[0].shape[1] != d):
            raise ValueError("vectors of unequal lengths")
        held.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
        rows += len(column)
        if rows >= BLOCK * d:
            factor = _upper(np.vstack(held if factor is None else [factor, *held]))
            held, rows = [], 0
    if held:
        factor = _upper(np.vstack(held if factor is None else [factor, *held]))
    if factor is not None:
        n = len(factor)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(range(n), pa.int32()),
             pa.array(list(factor), pa.list_(pa.float64()))], names=["_part", "_at", "row"])


def _merge(key, table):
    """Rows of the factor of a few factors, taken in the order of their splits."""
    table = table.sort_by([("_part", "ascending"), ("_at", "ascending")])
    x = table.column("row").combine_chunks()
    factor = _upper(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
    n = len(factor)
    return pa.table({"_part": pa.array([key[0].as_py()] * n, pa.int64()), "_at": pa.array(range(n), pa.int32()),
                     "row": pa.array(list(factor), pa.list_(pa.float64()))})


def triangular_factor(df: DataFrame, vec: str, fan_in: int = FAN_IN) -> DataFrame:
    """(_part, _at, row): the upper triangular R with R'R = sum of vec vec', one row of R in each row."""
    send_package(df.sparkSession)
    level = stored(df.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(_split_factor, _SCHEMA), "factors")
    parts = 1 + (level.agg(F.max("_part")).first()[0] or 0)
    while parts > 1:
        up = level.withColumn("_up", F.floor(F.col("_part") / fan_in))
        level = up.groupBy("_up").applyInArrow(_merge, _SCHEMA)
        parts = -(-parts // fan_in)
    return level


def factor_to_numpy(rows: DataFrame) -> np.ndarray:
    """The factor on the driver (at most d x d numbers, d the length of a vector)."""
    found = sorted((r["_at"], r["row"]) for r in rows.collect())
    return np.array([row for _, row in found], np.float64).reshape(len(found), -1 if found else 0)


def singular_vectors(df: DataFrame, vec: str, fan_in: int = FAN_IN) -> tuple[np.ndarray, np.ndarray]:
    """d singular values (descending) and the right singular vectors as columns; the largest loading of each is positive."""
    r = factor_to_numpy(triangular_factor(df, vec, fan_in))
    if not r.size:
        return np.zeros(0), np.zeros((0, 0))
    d = r.shape[1]
    _, sigma, vt = np.linalg.svd(np.vstack([r, np.zeros((max(0, d - len(r)), d))]))
    v = vt.T
    signs = np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(d)])
    return sigma, v * np.where(signs == 0, 1.0, signs)
