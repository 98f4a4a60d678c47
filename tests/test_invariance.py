"""Registered queries give the same rows under different partitionings (file splits, shuffle width, AQE)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["match_contains", "vector_diff", "model_suite", "looic", "variation_assemble", "classification_metrics",
         "residual_gram", "label_encode", "golden_check", "draw_quantiles"]


def _rows(spark, name):
    return sorted(tuple(r) for r in E.queries()[name](spark, SF).collect())


@pytest.mark.parametrize("name", NAMES)
def test_partitioning_invariance(spark, name):
    base = _rows(spark, name)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        other = _rows(spark, name)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert base == other
