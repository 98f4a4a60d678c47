"""Corpus pipeline: classify, dedup lines, join near copies, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents; what a stage drops or edits is gone for the next.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textcontrols.llm import line_dedup, ngram_join, packing, quality_classifier, secrets
from textcontrols.llm.queries import PATTERN, RANKS, TOKENIZER
from textcontrols.llm.work import written
from textcontrols.sources.tables import load_table

#: Near copies: shingles of five words, Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PCT = 5, 80
#: Bytes that a task gives to Python at once, unless the session says otherwise; workers are kept, with the most they ever held.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def _with_text(columns: list[str], row: str, text) -> list:
    """The columns of a row struct with a new text and its length."""
    made = []
    for c in columns:
        value = F.col(row).getField(c)
        if c == "text":
            value = text
        elif c == "n_chars":
            value = F.length(text).cast("long")
        made.append(value.alias(c))
    return made


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, load_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned repeated lines go; so does a document that held nothing else."""
    found = line_dedup.dedup(docs, once=True)
    kept = found.where((F.col("n_removed_lines") == 0) | (F.trim(F.col("left")) != ""))
    return kept.select(*_with_text(docs.columns, "row", F.col("left")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays; of equal rows one.

    A row without an id stays only where its whole group has none.
    """
    groups = ngram_join.join_components(docs, SHINGLE_WORDS, SIMILARITY_PCT)
    stay = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("stay_id"), F.col("text_key").alias("stay_key")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("key") == F.col("stay_key")), "left_semi")
    same = Window.partitionBy("id", "key").orderBy("id")
    return kept.withColumn("nth", F.row_number().over(same)).where("nth = 1").select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    text = secrets.masked(F.col("text"), RANKS, PATTERN)
    edited = docs.select(F.struct("*").alias("row"), text.alias("masked"))
    return edited.select(*_with_text(docs.columns, "row", F.col("masked")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, TOKENIZER, PATTERN)


def _in_batches(stage):
    """The stage, in a session whose batches are bounded by their bytes; the setting stays, as the result runs later."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not spark.conf.get(BATCH_SETTING, None):
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_classifier", _in_batches(quality_stage)),
    ("line_dedup", _in_batches(line_stage)),
    ("ngram_join", _in_batches(near_copy_stage)),
    ("secret_scan", _in_batches(secret_stage)),
    ("packing", _in_batches(packing_stage)),
]

#: Models, components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
