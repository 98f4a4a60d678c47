"""Small plan helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest row count of a side that an operator broadcasts after counting it.
DEFAULT_BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if an exact count proves it has at most ``max_rows`` rows.

    Returns ``(df_or_hinted_df, broadcast_used)``.  Beyond the bound the plain
    frame is returned and Spark shuffles (AQE may still pick a broadcast from
    runtime statistics, which is itself size-checked).
    """
    n = df.count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False


def text_key(c) -> list:
    """Two independent 64-bit hashes of a string: rows are joined to per-text results on 16 bytes, not on the text."""
    return [F.xxhash64(c).alias("_h1"), F.xxhash64(F.lit("textcontrols"), c).alias("_h2")]


def materialize_small(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small intermediate (moments, lookups) that several branches read.

    Written once to the shared folder named by ``spark.checkpoint.dir`` (set by
    the cluster; only tests set their own), so branches do not recompute it,
    the lineage is cut, and a lost executor does not lose it.
    """
    from textcontrols.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    cached = df.persist()  # computed once, then written from the cache
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read back: no copy on local disks."""
    import uuid

    from textcontrols.session import checkpoint_dir

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(df: DataFrame, by: Sequence[str], n_parts: int | None = None) -> DataFrame:
    """``df`` in ranges of the columns ``by``, written, with ``_pid``: the slice of a row, in the order of the ranges.

    Rows that are equal in all of ``by`` share a slice; a last column that
    tells them apart lets a run of ties cross slices.
    """
    n_parts = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n_parts, *by).withColumn("_pid", F.spark_partition_id()), "slices")


def average_ranks(df: DataFrame, group_col: str, value_col: str, tie_col: str, out: str = "rank") -> DataFrame:
    """1-based rank of each row within its group by ``value_col``, equal values at their average (column ``out``).

    ``tie_col`` tells equal values apart, so that a value which many rows share is spread
    over slices.  Only counts of (slice, value) are summed up: a value's first
    place is the least of its slices', its number the sum.
    """
    from pyspark.sql import Window

    cut = slices(df, [group_col, value_col, tie_col])
    counts = stored(cut.groupBy(group_col, "_pid", value_col).agg(F.count(F.lit(1)).alias("_c")), "counts")
    whole = counts.groupBy(group_col, "_pid").agg(F.sum("_c").alias("_all"))
    before = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    offsets = whole.select(group_col, "_pid", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_pid", group_col).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(offsets, [group_col, "_pid"]).withColumn("_first", F.col("_off") + F.sum("_c").over(within) - F.col("_c"))
    runs = placed.groupBy(group_col, value_col).agg(F.min("_first").alias("_first"), F.sum("_c").alias("_n"))
    ranks = counts.select(group_col, "_pid", value_col).join(
        runs.select(group_col, value_col, (F.col("_first") + (F.col("_n") + 1) / 2).alias(out)), [group_col, value_col])
    return cut.join(ranks, [group_col, "_pid", value_col]).drop("_pid")


def dense_rank_by(df: DataFrame, group_col: str, order_col: str, out: str = "code",
                  n_parts: int | None = None) -> DataFrame:
    """0-based place of each row in the order of ``order_col`` within ``group_col``, distributed (ties in any order).

    The rows are range-partitioned on (group, order) and written once, so each
    partition holds a sorted slice with a stable partition id.  Per (partition,
    group) counts form a small table whose running sums give each slice's
    offset; the rank is offset + row number inside the slice.  No window spans
    a whole group, so a group with very many levels is still spread over tasks.
    """
    from pyspark.sql import Window

    sliced = slices(df, [group_col, order_col], n_parts)
    counts = sliced.groupBy(group_col, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group_col, "_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    offsets_b, _ = bounded_broadcast(offsets)  # at most partitions x groups rows
    local = F.row_number().over(Window.partitionBy("_pid", group_col).orderBy(order_col)) - 1
    j = sliced.join(offsets_b, [group_col, "_pid"], "inner")
    return j.withColumn(out, (F.col("_off") + local).cast("long")).drop("_pid", "_off")
