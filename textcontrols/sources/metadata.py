"""Model metadata as JSON documents (nested structs, arrays, nulls)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_json_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document; nested objects become structs."""
    return spark.read.option("multiLine", True).json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Write a one-row manifest table as JSON (overwrites)."""
    df.coalesce(1).write.mode("overwrite").json(path)
