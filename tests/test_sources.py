"""Sources and sinks: JSON metadata, snapshots, CSV writing, control-column order."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from textcontrols.functions.recode import control_columns
from textcontrols.operators.validate import golden_check_values
from textcontrols.sources.metadata import read_json_metadata
from textcontrols.sources.snapshot import materialize, write_table


def test_control_columns_numeric_order():
    assert control_columns(["x", "INTN10", "INTN2", "INTN1", "INTNx"]) == ["INTN1", "INTN2", "INTN10"]


def test_json_metadata_nested(spark):
    d = tempfile.mkdtemp(prefix="tc-json-")
    doc = {"attributes": ["a", "b"], "n_samples": 12, "k": None,
           "metrics": {"a": {"accuracy": 0.5, "num_classes": 2}}}
    with open(os.path.join(d, "manifest.json"), "w") as f:
        json.dump(doc, f, indent=2)
    r = read_json_metadata(spark, os.path.join(d, "manifest.json")).collect()[0]
    assert r.attributes == ["a", "b"] and r.n_samples == 12 and r.metrics.a.num_classes == 2


def test_materialize_builds_once(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tc-snap-"), "t")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("sq", F.col("id") * F.col("id"))

    a = materialize(spark, path, build)
    b = materialize(spark, path, build)
    assert calls == [1] and sorted(r.sq for r in b.collect()) == [0, 1, 4, 9, 16] and a.count() == 5


def test_write_csv_roundtrip(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tc-csv-out-"), "t")
    df = spark.createDataFrame([("a, b", 1), ('say "x"', 2)], "t string, n int")
    write_table(df, path, "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert sorted(r.t for r in back.collect()) == ["a, b", 'say "x"']


def test_golden_values_looic_and_n(spark):
    g = spark.createDataFrame([("F", "looic", 1527.5), ("F", "n", 353.0), ("O", "looic", 1.0)],
                              "file string, label string, gt double")
    a = spark.createDataFrame([("F", "looic", 1527.54), ("F", "n", 353.0)], "file string, label string, value double")
    out = {(r.file, r.label): r.status for r in golden_check_values(g, a, ["file", "label"]).collect()}
    assert out == {("F", "looic"): "MATCH", ("F", "n"): "MATCH", ("O", "looic"): "MISSING"}


def test_resolve_source_prefers_first_complete(spark):
    from textcontrols.sources.snapshot import resolve_source
    root = tempfile.mkdtemp(prefix="tc-resolve-")
    shipped, built = os.path.join(root, "shipped"), os.path.join(root, "built")
    spark.range(3).write.parquet(built)
    assert resolve_source(spark, [shipped, built]) == built
    spark.range(2).write.parquet(shipped)
    assert resolve_source(spark, [shipped, built]) == shipped
    assert resolve_source(spark, [os.path.join(root, "none")]) is None
