"""Validation: key coverage, null guards, golden-value checks, fit worklists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tolerances of the golden check (estimates and errors rounded to
# three decimals, LOOIC rounded to one decimal).
EST_TOL = 0.0015
LOOIC_TOL = 0.15


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only left, only right, in both (full outer join on distinct keys)."""
    lk = left.select(F.col(key).alias("_k")).distinct().withColumn("_l", F.lit(True))
    rk = right.select(F.col(key).alias("_k")).distinct().withColumn("_r", F.lit(True))
    j = lk.join(rk, "_k", "full")
    return j.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNull()).alias("n_left_only"),
                 F.count_if(F.col("_l").isNull() & F.col("_r").isNotNull()).alias("n_right_only"),
                 F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_null, n_nan) for each column, one pass."""
    aggs = []
    for c in cols:
        is_num = dict(df.dtypes)[c] in ("double", "float")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"),
                 (F.count_if(F.isnan(c)) if is_num else F.lit(0).cast("long")).alias(f"{c}__nan")]
    w = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__null").alias("n_null"),
                                        F.col(f"{c}__nan").alias("n_nan")) for c in cols]))
    return w.select(rows.alias("_r")).select("_r.*")


def assert_no_missing(df: DataFrame, cols: Sequence[str]) -> None:
    """Raise if any of ``cols`` holds null or NaN (the control-column guard)."""
    bad = [r["column"] for r in null_counts(df, cols).collect() if r["n_null"] or r["n_nan"]]
    if bad:
        raise ValueError(f"null or NaN in control columns: {bad}")


def golden_check(golden: DataFrame, actual: DataFrame, keys: Sequence[str], tol: float = EST_TOL,
                 digits: int = 3) -> DataFrame:
    """Golden rows left-joined to the actual values; status MATCH / MISMATCH / MISSING.

    golden: keys + gt_est (+ gt_se, may be null); actual: keys + estimate (+ est_error).
    A golden row without an actual value is MISSING (and fails the check).
    """
    a = actual.select(*keys, "estimate", "est_error")
    j = golden.join(a, list(keys), "left")
    est_ok = F.abs(F.round("estimate", digits) - F.col("gt_est")) < tol
    se_ok = F.col("gt_se").isNull() | (F.abs(F.round("est_error", digits) - F.col("gt_se")) < tol)
    status = (F.when(F.col("estimate").isNull(), "MISSING")
              .when(est_ok & se_ok, "MATCH").otherwise("MISMATCH"))
    return j.select(*keys, "gt_est", F.round("estimate", digits).alias("estimate"), status.alias("status"))


def golden_summary(checked: DataFrame) -> DataFrame:
    """n_checked, n_match, n_mismatch, n_missing and ``all_ok`` (false on any missing)."""
    return checked.agg(F.count(F.lit(1)).alias("n_checked"),
                       F.count_if(F.col("status") == "MATCH").alias("n_match"),
                       F.count_if(F.col("status") == "MISMATCH").alias("n_mismatch"),
                       F.count_if(F.col("status") == "MISSING").alias("n_missing")) \
        .withColumn("all_ok", (F.col("n_checked") > 0) & (F.col("n_match") == F.col("n_checked")))


def fit_worklist(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fits to run: wanted (keys + fingerprint) without a cached result under the same fingerprint."""
    return wanted.join(cache.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def golden_check_values(golden: DataFrame, actual: DataFrame, keys: Sequence[str], digits: int = 1,
                        tol: float = LOOIC_TOL) -> DataFrame:
    """Scalar golden values (e.g. LOOIC): ``abs(round(value, digits) - gt) < tol``; MISSING without actual.

    golden: keys + gt; actual: keys + value.  With ``digits=None`` and
    ``tol=0`` this is an exact check (sample sizes).
    """
    j = golden.join(actual.select(*keys, "value"), list(keys), "left")
    v = F.round("value", digits) if digits is not None else F.col("value")
    ok = (F.abs(v - F.col("gt")) < tol) if tol > 0 else (v == F.col("gt"))
    status = F.when(F.col("value").isNull(), "MISSING").when(ok, "MATCH").otherwise("MISMATCH")
    return j.select(*keys, "gt", "value", status.alias("status"))
