"""Queries: catalog scan and merge, variation expansion and assembly, worklist, originals, design check.

Catalog stand-in from ``part``: description_id = 'p' || p_partkey, description =
p_name, treatment = p_brand, profile = p_type, length_condition by p_size,
experiment by p_retailprice.  Generated text stand-in: "<strategy>: <text>".
The response cache holds the summarize requests of parts with p_size <= 25;
identical requests (same strategy, text and variation) share one cache entry.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textcontrols.functions.text import word_count
from textcontrols.operators import catalog as C
from textcontrols.plans.registry import query
from textcontrols.plans.sqltext import wc
from textcontrols.sources.tables import load_table

N = C.N_VARIATIONS
S = len(C.STRATEGIES)
ATTRS = ["treatment", "profile", "length_condition", "experiment"]


def catalog(spark, sf):
    p = load_table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("description_id"),
        F.col("p_partkey").alias("base_key"), F.col("p_size").alias("size"),
        F.col("p_name").alias("description"), F.col("p_brand").alias("treatment"), F.col("p_type").alias("profile"),
        F.when(F.col("p_size") <= 15, "short").when(F.col("p_size") <= 35, "medium").otherwise("long")
         .alias("length_condition"),
        F.when(F.col("p_retailprice") < 1500, "exp_a").otherwise("exp_b").alias("experiment"),
        word_count("p_name").alias("word_count"))


CATALOG_SQL = f"""(SELECT 'p' || CAST(p_partkey AS VARCHAR) AS description_id, p_partkey AS base_key, p_size AS size,
  p_name AS description, p_brand AS treatment, p_type AS profile,
  CASE WHEN p_size <= 15 THEN 'short' WHEN p_size <= 35 THEN 'medium' ELSE 'long' END AS length_condition,
  CASE WHEN p_retailprice < 1500 THEN 'exp_a' ELSE 'exp_b' END AS experiment,
  {wc('p_name')} AS word_count FROM part)"""


@query("catalog_scan", sql=f"""SELECT description_id, description, treatment, profile, length_condition,
  experiment, word_count FROM {CATALOG_SQL}""")
def catalog_scan(spark, sf):
    return catalog(spark, sf).drop("base_key", "size")


@query("catalog_merge", sql=f"""
SELECT description_id, CASE WHEN size >= 20 THEN upper(description) ELSE description END AS description,
       treatment, size >= 20 AS from_right
FROM {CATALOG_SQL}""")
def catalog_merge(spark, sf):
    c = catalog(spark, sf).select("description_id", "description", "treatment", "size")
    left = c.where(F.col("size") <= 30).drop("size")
    right = c.where(F.col("size") >= 20).withColumn("description", F.upper("description")).drop("size")
    return C.merge_catalogs(left, right, "description_id")


def _expanded(spark, sf):
    cat = C.dense_index(catalog(spark, sf), "base_key").withColumnRenamed("_pos", "base_pos")
    return C.expand_variations(cat, C.STRATEGIES, "description_id", "base_pos", N)


_STRAT_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', {t}, {m})" for i, (n, t, m) in enumerate(C.STRATEGIES)) + \
    ") AS s(strategy_pos, strategy, temperature, max_tokens))"
EXPANDED_SQL = f"""(SELECT c.*, s.strategy, s.strategy_pos, v.variation,
  CAST(c.base_pos * {S * N} + s.strategy_pos * {N} + v.variation - 1 AS BIGINT) AS running_index
FROM (SELECT *, row_number() OVER (ORDER BY base_key) - 1 AS base_pos FROM {CATALOG_SQL}) c,
     {_STRAT_SQL} s, (SELECT unnest(range(1, {N + 1})) AS variation) v)"""


@query("variation_expand", sql=f"""
SELECT description_id || '_' || strategy || '_' || CAST(running_index AS VARCHAR) AS augmented_id,
       description_id AS base_description_id, strategy AS augmentation_strategy,
       CAST(variation AS INTEGER) AS variation, running_index
FROM {EXPANDED_SQL}""")
def variation_expand(spark, sf):
    x = _expanded(spark, sf)
    return x.select("augmented_id", F.col("description_id").alias("base_description_id"),
                    F.col("strategy").alias("augmentation_strategy"), "variation", "running_index")


def _generated(spark, sf):
    """Stand-in generated texts for every request (no model call)."""
    r = _expanded(spark, sf)
    return r.select("augmented_id", F.col("description_id").alias("base_description_id"), "strategy",
                    F.concat(F.col("strategy"), F.lit(": "), F.col("description")).alias("description"))


def _assembled(spark, sf):
    return C.assemble(catalog(spark, sf), _generated(spark, sf), "description_id", ATTRS)


ASSEMBLED_SQL = f"""(SELECT strategy || ': ' || description AS description,
   description_id || '_' || strategy || '_' || CAST(running_index AS VARCHAR) AS augmented_id,
   description_id AS base_description_id, treatment, profile, length_condition, experiment,
   strategy AS augmentation_strategy, false AS is_original FROM {EXPANDED_SQL}
 UNION ALL
 SELECT description, description_id, description_id, treatment, profile, length_condition, experiment,
   'original', true FROM {CATALOG_SQL})"""


@query("variation_assemble", sql=f"""
SELECT augmented_id, base_description_id, treatment, profile, augmentation_strategy, is_original,
       md5(description) AS description_md5 FROM {ASSEMBLED_SQL}""")
def variation_assemble(spark, sf):
    a = _assembled(spark, sf)
    return a.select("augmented_id", "base_description_id", "treatment", "profile", "augmentation_strategy",
                    "is_original", F.md5("description").alias("description_md5"))


REQUESTS_SQL = f"""(SELECT t.description, s.strategy, CAST(v.variation AS INTEGER) AS variation, t.n_bases, t.size,
  sha256(concat_ws(chr(1), s.strategy, t.description, CAST(v.variation AS VARCHAR))) AS request_hash
FROM (SELECT description, count(*) AS n_bases, min(size) AS size FROM {CATALOG_SQL} GROUP BY description) t,
     {_STRAT_SQL} s, (SELECT unnest(range(1, {N + 1})) AS variation) v)"""


def _requests_and_cache(spark, sf):
    """Distinct requests, and a cache that holds the summaries of texts of parts with p_size <= 25."""
    c = catalog(spark, sf)
    requests = C.distinct_requests(c, "description")
    cache = (C.distinct_requests(c.where(F.col("size") <= 25), "description", C.STRATEGIES[:1])
             .select("request_hash", F.concat_ws(" #", F.col("description"), F.col("variation")).alias("response")))
    return requests, cache


@query("prompt_worklist", sql=f"""
SELECT request_hash, strategy, variation, CAST(n_bases AS BIGINT) AS n_bases FROM {REQUESTS_SQL} r
WHERE NOT (size <= 25 AND strategy = '{C.STRATEGIES[0][0]}')""")
def prompt_worklist(spark, sf):
    requests, cache = _requests_and_cache(spark, sf)
    return C.worklist(requests, cache).select("request_hash", "strategy", "variation", "n_bases")


@query("prompt_fill", sql=f"""
SELECT request_hash, strategy, variation, CAST(n_bases AS BIGINT) AS n_bases,
       description || ' #' || CAST(variation AS VARCHAR) AS response FROM {REQUESTS_SQL} r
WHERE size <= 25 AND strategy = '{C.STRATEGIES[0][0]}'""")
def prompt_fill(spark, sf):
    requests, cache = _requests_and_cache(spark, sf)
    return C.fill_from_cache(requests, cache).select("request_hash", "strategy", "variation", "n_bases", "response")


@query("request_mapping", sql=f"""
SELECT description_id || '_' || strategy || '_' || CAST(running_index AS VARCHAR) AS augmented_id,
       sha256(concat_ws(chr(1), strategy, description, CAST(variation AS VARCHAR))) AS request_hash FROM {EXPANDED_SQL}""")
def request_mapping(spark, sf):
    """Which request answers which augmented row."""
    x = _expanded(spark, sf)
    return x.select("augmented_id", C.request_hash("strategy", "description", "variation").alias("request_hash"))


@query("originals_only", sql=f"""
SELECT base_description_id AS description_id, description, treatment, profile FROM {ASSEMBLED_SQL} WHERE is_original""")
def originals_only(spark, sf):
    a = C.canonical_ids(C.originals(catalog(spark, sf), "description_id", ATTRS).withColumnRenamed("augmented_id", "description_id"))
    return a.select("description_id", "description", "treatment", "profile")


@query("augmentation_counts", sql=f"""
SELECT experiment, CAST(count_if(is_original) AS BIGINT) AS n_original, CAST(count_if(NOT is_original) AS BIGINT) AS n_augmented
FROM {ASSEMBLED_SQL} GROUP BY experiment""")
def augmentation_counts(spark, sf):
    return _assembled(spark, sf).groupBy("experiment").agg(
        F.count_if("is_original").alias("n_original"), F.count_if(~F.col("is_original")).alias("n_augmented"))


DESIGN = ["experiment", "treatment", "profile"]
_DESIGN_SQL = "experiment || '|' || treatment || '|' || profile"


@query("design_check", sql=f"""
WITH a AS {ASSEMBLED_SQL}, c AS {CATALOG_SQL}, nb AS (SELECT count(*) AS nb FROM c),
seen AS (SELECT 'strategy' AS "check", augmentation_strategy AS cell, count(*) AS observed FROM a GROUP BY ALL
  UNION ALL SELECT 'attributes', {_DESIGN_SQL}, count(*) FROM a GROUP BY ALL
  UNION ALL SELECT 'base', 'mismatched', count_if(k <> {S * N + 1}) FROM (SELECT count(*) AS k FROM a GROUP BY base_description_id)),
want AS (SELECT 'strategy' AS "check", strategy AS cell, nb * {N} AS expected FROM {_STRAT_SQL}, nb
  UNION ALL SELECT 'strategy', 'original', nb FROM nb UNION ALL SELECT 'base', 'mismatched', 0
  UNION ALL SELECT 'attributes', {_DESIGN_SQL}, count(*) * {S * N + 1} FROM c GROUP BY ALL)
SELECT "check", cell, CAST(coalesce(observed, 0) AS BIGINT) AS observed, CAST(coalesce(expected, 0) AS BIGINT) AS expected,
       coalesce(observed, 0) = coalesce(expected, 0) AS ok
FROM seen FULL JOIN want USING ("check", cell)""")
def design_check(spark, sf):
    expected = C.expected_cells(catalog(spark, sf), "description_id", DESIGN)
    return C.design_check(_assembled(spark, sf), expected, DESIGN, S * N + 1)
