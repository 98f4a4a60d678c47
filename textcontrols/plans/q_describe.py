"""Queries: value counts, crosstab, levels, summaries, condition tables, correlations, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcontrols.operators import describe as D
from textcontrols.operators.draws import draw_quantiles
from textcontrols.plans.q_models import FRAME_SQL, model_frame
from textcontrols.plans.q_recode import ANALYSIS_SQL, analysis_rows
from textcontrols.plans.registry import query
from textcontrols.sources.tables import load_table


@query("value_counts", sql="""
SELECT 'documents' AS source, attribute, level, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'lang' AS attribute, lang AS level FROM documents UNION ALL SELECT 'source', source FROM documents)
GROUP BY attribute, level
UNION ALL
SELECT 'events', 'event_type', event_type, CAST(count(*) AS BIGINT) FROM events GROUP BY event_type""")
def value_counts(spark, sf):
    d = D.value_counts(load_table(spark, sf, "documents"), ["lang", "source"]).withColumn("source", F.lit("documents"))
    e = D.value_counts(load_table(spark, sf, "events"), ["event_type"]).withColumn("source", F.lit("events"))
    return d.unionByName(e).select("source", "attribute", "level", "n")


@query("crosstab", sql="""
SELECT returnflag, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS n_F,
       CAST(count_if(l_linestatus IS DISTINCT FROM 'F') AS BIGINT) AS n_other
FROM (SELECT l_returnflag AS returnflag, l_linestatus FROM lineitem) GROUP BY returnflag""")
def crosstab(spark, sf):
    """One listed level; what isn't listed is counted as other."""
    li = load_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("returnflag"), "l_linestatus")
    return D.crosstab(li, "returnflag", "l_linestatus", ["F"])


@query("distinct_levels", sql="""
SELECT attribute, level, CAST(count(*) OVER (PARTITION BY attribute) AS BIGINT) AS n_levels FROM (
  SELECT DISTINCT 'lang' AS attribute, lang AS level FROM documents WHERE lang IS NOT NULL
  UNION SELECT DISTINCT 'source', source FROM documents WHERE source IS NOT NULL)""")
def distinct_levels(spark, sf):
    return D.distinct_levels(load_table(spark, sf, "documents"), ["lang", "source"])


SUMMARY_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("control_summary", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"CAST({len(SUMMARY_COLS) - 3} AS BIGINT) AS n_not_reported FROM lineitem"
    for c in SUMMARY_COLS[:3]))
def control_summary(spark, sf):
    out = D.column_summary(load_table(spark, sf, "lineitem"), SUMMARY_COLS, report=3)
    return out.select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_not_reported")


_ROLE_SQL = "regexp_extract(ComparisonCondition, '^(Base|Short|Long)', 1)"


@query("condition_counts", sql=f"""
SELECT BaseOnLeft AS base_on_left_text, CAST(count_if({_ROLE_SQL} = 'Base') AS BIGINT) AS n_base,
  CAST(count_if({_ROLE_SQL} = 'Short') AS BIGINT) AS n_short, CAST(count_if({_ROLE_SQL} = 'Long') AS BIGINT) AS n_long,
  CAST(count_if({_ROLE_SQL} = '') AS BIGINT) AS n_other, CAST(count(*) AS BIGINT) AS n_total
FROM {ANALYSIS_SQL} WHERE ComparisonCondition <> '' GROUP BY BaseOnLeft""")
def condition_counts(spark, sf):
    rows = analysis_rows(spark, sf).where(F.col("ComparisonCondition") != "")
    return D.condition_counts(rows, "BaseOnLeft", "ComparisonCondition").withColumnRenamed("BaseOnLeft", "base_on_left_text")


MEAN_COLS = ["wc_diff", "wc2_diff", "INTN1", "INTN2"]


@query("control_means", sql="SELECT experiment, CAST(count(*) AS BIGINT) AS n, " + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in MEAN_COLS) + f"""
FROM (SELECT *, wc_diff * wc_diff AS wc2_diff FROM {FRAME_SQL}) GROUP BY experiment""")
def control_means(spark, sf):
    """Means of every control and of the word-count differences per experiment."""
    f = model_frame(spark, sf).withColumn("wc2_diff", F.col("wc_diff") * F.col("wc_diff"))
    out = D.means(f, ["experiment"], MEAN_COLS)
    return out.select("experiment", "n", *[F.round(c, 6).alias(c) for c in MEAN_COLS])


@query("condition_means", sql=f"""
SELECT condition, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean
FROM {ANALYSIS_SQL} WHERE condition IS NOT NULL GROUP BY condition""")
def condition_means(spark, sf):
    out = D.condition_means(analysis_rows(spark, sf), [], "condition", "value")
    return out.select("condition", "n", F.round("mean", 6).alias("mean"))


CORR_PAIRS = [("INTN1", "wc_diff"), ("INTN2", "wc_diff"), ("y", "wc_diff")]


@query("control_corr", sql=" UNION ALL ".join(
    f"SELECT experiment, '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM {FRAME_SQL} GROUP BY experiment"
    for a, b in CORR_PAIRS))
def control_corr(spark, sf):
    out = D.correlations(model_frame(spark, sf), ["experiment"], CORR_PAIRS)
    return out.withColumn("r", F.round("r", 6))


_PC = """SELECT experiment, '{x}' AS x,
  round((corr({x}, wc2) - corr({x}, wc_diff) * corr(wc2, wc_diff))
        / sqrt((1 - corr({x}, wc_diff) * corr({x}, wc_diff)) * (1 - corr(wc2, wc_diff) * corr(wc2, wc_diff))), 6) AS partial_r
FROM (SELECT *, wc_diff * wc_diff AS wc2 FROM {frame}) GROUP BY experiment"""


@query("partial_corr", sql=" UNION ALL ".join(_PC.format(x=x, frame=FRAME_SQL) for x in ["INTN1", "INTN2"]))
def partial_corr(spark, sf):
    f = model_frame(spark, sf).withColumn("wc2", F.col("wc_diff") * F.col("wc_diff"))
    out = D.partial_correlations(f, ["experiment"], ["INTN1", "INTN2"], "wc2", "wc_diff")
    return out.withColumn("partial_r", F.round("partial_r", 6))


@query("draw_quantiles", sql="""
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean,
       round(quantile_cont(value, 0.025), 6) AS q025, round(quantile_cont(value, 0.5), 6) AS q500,
       round(quantile_cont(value, 0.975), 6) AS q975
FROM events GROUP BY event_type""")
def draw_quantiles_q(spark, sf):
    out = draw_quantiles(load_table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "q025", "q500", "q975")])
