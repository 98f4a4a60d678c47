"""Queries: text normalisation, word counts, paired word-count differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcontrols.functions.text import normalize_text, word_count
from textcontrols.plans.frames import conversation_word_counts
from textcontrols.plans.registry import query
from textcontrols.plans.sqltext import norm, wc
from textcontrols.sources.tables import load_table


@query("text_normalize", sql=f"""
SELECT doc_id, CAST(length({norm('text')}) AS BIGINT) AS norm_length, md5({norm('text')}) AS norm_md5
FROM documents""")
def text_normalize(spark, sf):
    n = normalize_text("text")
    return load_table(spark, sf, "documents").select(
        "doc_id", F.length(n).cast("long").alias("norm_length"), F.md5(n).alias("norm_md5"))


@query("word_count", sql=f"""
SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS turn, {wc('text')} AS word_count FROM documents
UNION ALL
SELECT 'conversations' AS source, conv_id AS id, turn, {wc('text')} AS word_count FROM conversations""")
def word_count_q(spark, sf):
    d = load_table(spark, sf, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"),
        word_count("text").alias("word_count"))
    c = load_table(spark, sf, "conversations").select(
        F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), "turn",
        word_count("text").alias("word_count"))
    return d.unionByName(c)


def paired_word_counts(pairs):
    return (pairs.withColumn("wc_diff", F.col("wc_comparison") - F.col("wc_base"))
            .withColumn("wc2_diff", F.col("wc_comparison") * F.col("wc_comparison")
                        - F.col("wc_base") * F.col("wc_base")))


CONV_PAIRS_SQL = """(SELECT u.conv_id, u.turn, u.text AS Text_Base, a.text AS Text_Comparison
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


@query("paired_wc_diff", sql=f"""
SELECT conv_id, turn, wc_base, wc_comparison, wc_comparison - wc_base AS wc_diff,
       wc_comparison * wc_comparison - wc_base * wc_base AS wc2_diff
FROM (SELECT conv_id, turn, {wc('Text_Base')} AS wc_base, {wc('Text_Comparison')} AS wc_comparison
      FROM {CONV_PAIRS_SQL})""")
def paired_wc_diff(spark, sf):
    return paired_word_counts(conversation_word_counts(spark, sf)).select(
        "conv_id", "turn", "wc_base", "wc_comparison", "wc_diff", "wc2_diff")
