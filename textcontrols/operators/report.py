"""Reporting: estimator x experiment summary table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: cell format "mean [lower, upper]" with three decimals.
CELL_FORMAT = "%.3f [%.3f, %.3f]"


def summary_table(est: DataFrame, row_col: str, pivot_col: str, levels: Sequence[str] | None = None,
                  prefix: str = "", fmt: str = CELL_FORMAT) -> DataFrame:
    """One row per estimator, one formatted column per experiment level.

    Without ``levels`` they are the distinct ones of the estimates (a summary
    table, one row for each estimator and experiment), in order.
    """
    if levels is None:
        levels = sorted(r[0] for r in est.select(pivot_col).where(F.col(pivot_col).isNotNull()).distinct().collect())
    cells = est.select(row_col, pivot_col, F.format_string(fmt, "estimate", "q_lo", "q_hi").alias("_cell"))
    wide = cells.groupBy(row_col).pivot(pivot_col, list(levels)).agg(F.first("_cell"))
    return wide.select(row_col, *[F.col(f"`{lv}`").alias(f"{prefix}{lv}") for lv in levels])
