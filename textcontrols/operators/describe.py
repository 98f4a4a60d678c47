"""Descriptive aggregates: counts, crosstabs, levels, summaries, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcontrols.functions.recode import role_of_condition
from textcontrols.operators._util import dense_rank_by


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(attribute, level, n) for each column; one pass, one shuffle.

    The columns are unpivoted with ``stack`` before the aggregate so every
    column shares a single partial+final aggregation.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level")) for c in cols])).alias("_s"))
    return stacked.groupBy("_s.attribute", "_s.level").agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence[str], prefix: str = "n_") -> DataFrame:
    """Counts of ``row`` x ``col`` for the given column levels, and ``{prefix}other`` for the rest (nulls too); 0 for empty cells."""
    counts = [F.count_if(F.coalesce(F.col(col) == lv, F.lit(False))).alias(f"{prefix}{lv}") for lv in levels]
    rest = F.count_if(F.coalesce(~F.col(col).isin(list(levels)), F.lit(True))).alias(f"{prefix}other")
    return df.groupBy(row).agg(*counts, rest)


def distinct_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(attribute, level, n_levels): one row for each distinct non-null level and the number of them."""
    vc = value_counts(df, cols).where(F.col("level").isNotNull()).select("attribute", "level")
    return vc.join(vc.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_levels")), "attribute")


def means(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """keys, n and the mean of every one of ``cols`` over its non-null values, one pass."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in cols])


def column_summary(df: DataFrame, cols: Sequence[str], report: int | None = None) -> DataFrame:
    """(column, mean, std) with the sample standard deviation, one aggregate pass.

    ``report`` keeps the first columns (in the given order); ``n_not_reported``
    counts the columns left out.
    """
    chosen = list(cols)[:report] if report else list(cols)
    aggs = []
    for c in chosen:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"),
                                        F.col(f"{c}__std").alias("std")) for c in chosen]))
    out = wide.select(rows.alias("_r")).select("_r.*")
    return out.withColumn("n_not_reported", F.lit(len(cols) - len(chosen)).cast("long"))


def condition_counts(df: DataFrame, group: str, cond: str, roles: Sequence[str] = ("Base", "Short", "Long")
                     ) -> DataFrame:
    """Per group: rows per role of the condition (null condition excluded), rows of any other condition, and the total."""
    r = df.where(F.col(cond).isNotNull()).select(group, role_of_condition(cond, roles).alias("_role"))
    return r.groupBy(group).agg(
        *[F.count_if(F.coalesce(F.col("_role") == x, F.lit(False))).alias(f"n_{x.lower()}") for x in roles],
        F.count_if(F.col("_role").isNull()).alias("n_other"), F.count(F.lit(1)).alias("n_total"))


def condition_means(df: DataFrame, keys: Sequence[str], cond: str, value: str) -> DataFrame:
    """Mean of ``value`` per condition (null condition excluded)."""
    return (df.where(F.col(cond).isNotNull()).groupBy(*keys, cond)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")))


def correlations(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(keys, x, y, r) Pearson correlation per group for each pair, one pass."""
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r"))
                               for i, (a, b) in enumerate(pairs)]))
    return wide.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def partial_correlations(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, z: str) -> DataFrame:
    """(keys, x, partial_r): correlation of each x with y given z.

    r_xy.z = (r_xy - r_xz r_yz) / sqrt((1 - r_xz^2)(1 - r_yz^2)); three corr per x, one pass.
    """
    aggs = [F.corr(y, z).alias("_ryz")]
    for i, x in enumerate(xs):
        aggs += [F.corr(x, y).alias(f"_rxy{i}"), F.corr(x, z).alias(f"_rxz{i}")]
    w = df.groupBy(*keys).agg(*aggs)
    rows = []
    for i, x in enumerate(xs):
        rxy, rxz, ryz = F.col(f"_rxy{i}"), F.col(f"_rxz{i}"), F.col("_ryz")
        pr = F.try_divide(rxy - rxz * ryz, F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz)))
        rows.append(F.struct(F.lit(x).alias("x"), pr.alias("partial_r")))
    return w.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(attribute, level, code): alphabetical 0-based codes per attribute.

    Distinct levels first (one aggregate), then a distributed dense rank over
    range-partitioned slices of the levels (no window spans a whole attribute).
    """
    lv = value_counts(df, cols).where(F.col("level").isNotNull()).select("attribute", "level")
    return dense_rank_by(lv, "attribute", "level", "code")
