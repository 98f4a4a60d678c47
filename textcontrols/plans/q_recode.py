"""Queries: lenient casts, reverse scoring, filter funnel, factors, recodes, label encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcontrols.functions.recode import (
    factor_level, factor_position, lenient_bool, lenient_double, recode_map, reverse_score,
)
from textcontrols.operators.describe import label_encode
from textcontrols.plans.frames import SURVEY_SQL, survey_rows
from textcontrols.plans.registry import query
from textcontrols.sources.tables import load_table

# Fixed parameters of the stand-in recodes.
SEGMENT_CONDITION = {"AUTOMOBILE": "base", "BUILDING": "base", "FURNITURE": "certified", "HOUSEHOLD": "certified"}
LANG_LEVELS = ("en", "fr", "de")
CONDITION_LEVELS = ("BaseFT", "ShortFT", "LongFT")


def _lenient_sql(c: str) -> str:
    number = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|Inf|NaN|(?i:infinity))$"
    return f"(CASE WHEN {c} <> 'NA' AND regexp_matches(trim({c}), '{number}') THEN TRY_CAST(trim({c}) AS DOUBLE) END)"


def _bool_sql(c: str) -> str:
    return (f"(CASE WHEN {c} IN ('T', 'TRUE', 'True', 'true') THEN true "
            f"WHEN {c} IN ('F', 'FALSE', 'False', 'false') THEN false END)")


def _pref_sql(flag: str, rating: str) -> str:
    return (f"(CASE WHEN {flag} IS NULL OR {rating} IS NULL THEN NULL WHEN {flag} = 1 THEN {rating} - 4 "
            f"ELSE 8 - {rating} - 4 END)")


def analysis_rows(spark, sf):
    """Typed survey rows: rating, flag, preference, factor condition, matched flag."""
    return analysis_columns(survey_rows(spark, sf))


def analysis_columns(s):
    """Typed analysis columns from raw survey columns (row-wise: batch or stream)."""
    rating, flag = lenient_double("DVPref_Rating_1"), lenient_double("BaseOnLeft")
    return s.select("event_id", "user_id", "value", "Q_TerminateFlag", "ComparisonCondition", "BaseOnLeft",
                    rating.alias("rating"), flag.alias("base_on_left"),
                    reverse_score(flag, rating).alias("Pref"),
                    factor_level("ComparisonCondition", CONDITION_LEVELS).alias("condition"),
                    lenient_bool("nuisance_matched").alias("matched"))


ANALYSIS_SQL = f"""(SELECT event_id, user_id, value, Q_TerminateFlag, ComparisonCondition, BaseOnLeft, rating, base_on_left,
  {_pref_sql('base_on_left', 'rating')} AS Pref,
  CASE WHEN ComparisonCondition IN {CONDITION_LEVELS!r} THEN ComparisonCondition END AS condition, matched
FROM (SELECT *, {_lenient_sql('DVPref_Rating_1')} AS rating, {_lenient_sql('BaseOnLeft')} AS base_on_left,
             {_bool_sql('nuisance_matched')} AS matched FROM {SURVEY_SQL}))"""


@query("lenient_cast", sql=f"SELECT event_id, rating, base_on_left, matched FROM {ANALYSIS_SQL}")
def lenient_cast(spark, sf):
    return analysis_rows(spark, sf).select("event_id", "rating", "base_on_left", "matched")


@query("reverse_score", sql=f"SELECT event_id, Pref FROM {ANALYSIS_SQL}")
def reverse_score_q(spark, sf):
    return analysis_rows(spark, sf).select("event_id", "Pref")


def funnel(rows):
    """Row counts after each filter of the analysis sequence, as one aggregate."""
    complete = F.col("Q_TerminateFlag") == "Complete"
    valid = complete & F.col("Pref").isNotNull() & ~F.isnan("Pref") & F.col("ComparisonCondition").isNotNull() \
        & (F.col("ComparisonCondition") != "")
    matched = valid & F.coalesce(F.col("matched"), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(complete).alias("n_complete"),
                    F.count_if(valid).alias("n_valid"), F.count_if(matched).alias("n_matched"),
                    F.count_if(matched & F.col("condition").isNull()).alias("n_matched_outside_levels"))


@query("filter_funnel", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS n_raw, CAST(count_if(c) AS BIGINT) AS n_complete,
       CAST(count_if(v) AS BIGINT) AS n_valid, CAST(count_if(m) AS BIGINT) AS n_matched,
       CAST(count_if(m AND condition IS NULL) AS BIGINT) AS n_matched_outside_levels
FROM (SELECT *, c AND v0 AS v, c AND v0 AND coalesce(matched, false) AS m
      FROM (SELECT *, Q_TerminateFlag = 'Complete' AS c,
                   Pref IS NOT NULL AND NOT isnan(Pref) AND ComparisonCondition IS NOT NULL AND ComparisonCondition <> '' AS v0
            FROM {ANALYSIS_SQL}))""")
def filter_funnel(spark, sf):
    return funnel(analysis_rows(spark, sf))


@query("factor_levels", sql=f"""
SELECT doc_id, CASE WHEN lang IN {LANG_LEVELS!r} THEN lang END AS lang_level,
       CAST(CASE lang {' '.join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(LANG_LEVELS))} END AS BIGINT) AS level_pos
FROM documents""")
def factor_levels(spark, sf):
    d = load_table(spark, sf, "documents")
    return d.select("doc_id", factor_level("lang", LANG_LEVELS).alias("lang_level"),
                    factor_position("lang", LANG_LEVELS).alias("level_pos"))


@query("recode_condition", sql=f"""
SELECT c_custkey, c_mktsegment,
       CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_CONDITION.items())} END AS condition
FROM customer""")
def recode_condition(spark, sf):
    c = load_table(spark, sf, "customer")
    return c.select("c_custkey", "c_mktsegment", recode_map("c_mktsegment", SEGMENT_CONDITION).alias("condition"))


@query("label_encode", sql="""
SELECT attribute, level, CAST(dense_rank() OVER (PARTITION BY attribute ORDER BY level) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT 'c_mktsegment' AS attribute, c_mktsegment AS level FROM customer WHERE c_mktsegment IS NOT NULL
      UNION SELECT DISTINCT 'lang', lang FROM documents WHERE lang IS NOT NULL)""")
def label_encode_q(spark, sf):
    a = label_encode(load_table(spark, sf, "customer"), ["c_mktsegment"])
    b = label_encode(load_table(spark, sf, "documents"), ["lang"])
    return a.unionByName(b)


_SPELLINGS = ("5", " 5.5 ", "5d", "5f", "1e3", "0x1A", ".5", "-Inf", "NA", "", "T", "t", "TRUE", "tRuE", " True ", "False", "F", "f")
_SPELLING_SQL = "list_extract([" + ", ".join(f"'{x}'" for x in _SPELLINGS) + f"], CAST(event_id % {len(_SPELLINGS)} AS INTEGER) + 1)"


@query("lenient_spellings", sql=f"""
SELECT event_id, spelling, {_lenient_sql('spelling')} AS number, {_bool_sql('spelling')} AS flag
FROM (SELECT event_id, {_SPELLING_SQL} AS spelling FROM events)""")
def lenient_spellings(spark, sf):
    e = load_table(spark, sf, "events")
    x = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.pmod("event_id", F.lit(len(_SPELLINGS))) + 1).cast("int"))
    e = e.select("event_id", x.alias("spelling"))
    return e.select("event_id", "spelling", lenient_double("spelling").alias("number"), lenient_bool("spelling").alias("flag"))
