"""Frames derived from the driver tables that several queries share.

Stand-ins, all computed by Spark from whole tables:

- catalog lookup: ``benchmark`` texts are the known stimuli, their control
  vector is the whole embedding with ``vec_id = item_id``;
- conversation pairs: each user turn (base) with the next turn when it is the
  assistant's (comparison);
- survey rows: ``events`` recast as raw survey columns (text typed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcontrols.functions.text import word_count
from textcontrols.operators.match import build_lookup
from textcontrols.sources.tables import load_table

# Fixed value: dimensions of the ``embeddings`` table, all of them controls.
N_CONTROLS = 64


def benchmark_lookup(spark: SparkSession, sf: str) -> DataFrame:
    b = load_table(spark, sf, "benchmark")
    e = load_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return build_lookup(b.join(e, b["item_id"] == e["vec_id"], "inner"), "text", "item_id", "embedding")


def conversation_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, wc_base, wc_comparison: counted where the texts are read, so the join moves numbers."""
    c = load_table(spark, sf, "conversations").select("conv_id", "turn", "role", word_count("text").alias("wc"))
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("wc").alias("wc_base"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("wc").alias("wc_comparison"))
    return u.join(a, ["conv_id", "turn"], "inner")


def survey_rows(spark: SparkSession, sf: str) -> DataFrame:
    return survey_columns(load_table(spark, sf, "events"))


def survey_columns(e: DataFrame) -> DataFrame:
    """events as raw survey text columns (row-wise: works on a stream too).

    Q_TerminateFlag: 'Complete' except error events; DVPref_Rating_1: 1 + k mod 7
    (text); BaseOnLeft: '1' click/purchase, '0' view/signup, 'NA' error;
    ComparisonCondition by event type (signup is outside the levels, error is
    empty); nuisance_matched: 'True' when value >= 5 else 'False'.
    """
    k = F.regexp_extract("props", r":\s*(-?[0-9]+)", 1).cast("long")
    return e.select(
        "event_id", "user_id", "value",
        F.when(F.col("event_type") == "error", "Screened").otherwise("Complete").alias("Q_TerminateFlag"),
        (F.pmod(k, F.lit(7)) + 1).cast("string").alias("DVPref_Rating_1"),
        F.when(F.col("event_type").isin("click", "purchase"), "1")
         .when(F.col("event_type").isin("view", "signup"), "0").otherwise("NA").alias("BaseOnLeft"),
        F.when(F.col("event_type") == "view", "BaseFT").when(F.col("event_type") == "click", "ShortFT")
         .when(F.col("event_type") == "purchase", "LongFT").when(F.col("event_type") == "signup", "MidFT")
         .otherwise("").alias("ComparisonCondition"),
        F.when(F.col("value") >= 5, "True").otherwise("False").alias("nuisance_matched"),
    )


SURVEY_SQL = """(SELECT event_id, user_id, value,
  CASE WHEN event_type = 'error' THEN 'Screened' ELSE 'Complete' END AS Q_TerminateFlag,
  CAST(((CAST(regexp_extract(props, ':\\s*(-?[0-9]+)', 1) AS BIGINT) % 7 + 7) % 7 + 1) AS VARCHAR) AS DVPref_Rating_1,
  CASE WHEN event_type IN ('click', 'purchase') THEN '1' WHEN event_type IN ('view', 'signup') THEN '0' ELSE 'NA' END AS BaseOnLeft,
  CASE event_type WHEN 'view' THEN 'BaseFT' WHEN 'click' THEN 'ShortFT' WHEN 'purchase' THEN 'LongFT'
       WHEN 'signup' THEN 'MidFT' ELSE '' END AS ComparisonCondition,
  CASE WHEN value >= 5 THEN 'True' ELSE 'False' END AS nuisance_matched
FROM events)"""
