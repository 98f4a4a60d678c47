"""Queries: tables written in each format to the shared folder and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textcontrols.functions.recode import lenient_double
from textcontrols.plans.frames import survey_rows
from textcontrols.plans.registry import query
from textcontrols.session import checkpoint_dir
from textcontrols.sources.metadata import read_json_metadata, write_manifest
from textcontrols.sources.snapshot import materialize, resolve_source, write_table
from textcontrols.sources.survey import read_analysis_csv, read_survey_csv
from textcontrols.sources.tables import load_table


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/source-{name}-{uuid.uuid4().hex}"


# Documents' first words carry the quotes, commas and line ends that a CSV must keep.
_TEXT_SQL = "CASE WHEN doc_id % 7 = 0 THEN 'say \"' || lang || '\",' || chr(10) || 'next line' WHEN doc_id % 7 = 1 THEN {} ELSE source END"


def _text(missing):
    quoted = F.concat(F.lit('say "'), F.col("lang"), F.lit('",\nnext line'))
    return (F.when(F.col("doc_id") % 7 == 0, quoted).when(F.col("doc_id") % 7 == 1, missing).otherwise(F.col("source")))


@query("survey_csv_roundtrip", sql=f"""
SELECT doc_id, {_TEXT_SQL.format('NULL')} AS answer, '2025-01-01 10:00:00' AS "StartDate" FROM documents""")
def survey_csv_roundtrip(spark, sf):
    """A raw survey export with its two metadata rows: they go, null tokens are null, quoted line ends stay."""
    d = load_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), _text(F.lit("N/A")).alias("answer"), F.lit("2025-01-01 10:00:00").alias("StartDate"))
    meta = d.limit(1).select(F.explode(F.array(F.lit("Start Date"), F.lit('{"ImportId":"startDate"}'))).alias("StartDate")).select(
        F.lit("x").alias("doc_id"), F.lit("question").alias("answer"), "StartDate")
    path = _folder(spark, "survey")
    write_table(d.unionByName(meta), path, "csv")
    return read_survey_csv(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "answer", "StartDate")


@query("analysis_csv_roundtrip", sql=f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_TEXT_SQL.format('NULL')} END AS answer FROM documents""")
def analysis_csv_roundtrip(spark, sf):
    """An analysis CSV: only NA is missing, an empty field is an empty string."""
    d = load_table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(_text(F.lit("NA"))).alias("answer"))
    path = _folder(spark, "analysis")
    write_table(d, path, "csv")
    return read_analysis_csv(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "answer")


@query("snapshot_roundtrip", sql="""
SELECT 'F' AS status, l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS quantity
FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag""")
def snapshot_roundtrip(spark, sf):
    """A partitioned snapshot, built once, found by its marker and read with partition pruning."""
    path = _folder(spark, "snapshot")
    build = lambda: load_table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity")
    materialize(spark, path, build, partition_by=["l_linestatus"])
    found = resolve_source(spark, [path + "-shipped", path])
    rows = materialize(spark, found, build).where(F.col("l_linestatus") == "F")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity")).select(
        F.lit("F").alias("status"), "l_returnflag", "n", "quantity")


@query("manifest_roundtrip", sql="""
SELECT attribute, level, n FROM (
  SELECT 'lang' AS attribute, lang AS level, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang
  UNION ALL SELECT 'n_samples', NULL, CAST(count(*) AS BIGINT) FROM documents)""")
def manifest_roundtrip(spark, sf):
    """A nested JSON manifest of the documents (levels with counts, sample size), written and read back."""
    d = load_table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    manifest = d.agg(F.sum("n").alias("n_samples"), F.collect_list(F.struct(F.col("lang").alias("level"), "n")).alias("levels"))
    path = _folder(spark, "manifest")
    write_manifest(manifest.select("n_samples", F.struct(F.lit("lang").alias("attribute"), "levels").alias("encoder")), path)
    m = read_json_metadata(spark, path)
    levels = m.select(F.col("encoder.attribute").alias("attribute"), F.explode("encoder.levels").alias("l")).select("attribute", "l.level", "l.n")
    return levels.unionByName(m.select(F.lit("n_samples").alias("attribute"), F.lit(None).cast("string").alias("level"), F.col("n_samples").alias("n")))


@query("survey_typed_roundtrip", sql="""
SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 1.0 WHEN event_type IN ('view', 'signup') THEN 0.0 END AS flag,
       CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def survey_typed_roundtrip(spark, sf):
    """Survey columns through CSV and the casts of the analysis: the flag NA is missing."""
    path = _folder(spark, "typed")
    write_table(survey_rows(spark, sf).select("event_id", "BaseOnLeft"), path, "csv")
    rows = read_analysis_csv(spark, path)
    return rows.groupBy(lenient_double("BaseOnLeft").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
