"""Queries: lookup build, exact / containment matching, match rates, vector differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcontrols.operators.match import enrich_neighbours, match_column, match_rates
from textcontrols.functions.text import normalize_text
from textcontrols.operators._util import text_key
from textcontrols.plans.frames import N_CONTROLS, benchmark_lookup
from textcontrols.plans.registry import query
from textcontrols.plans.sqltext import norm, wc
from textcontrols.sources.tables import load_table

LOOKUP_SQL = f"""(SELECT key, min(pos) AS pos, max_by(vec, pos) AS vec
  FROM (SELECT {norm('b.text')} AS key, b.item_id AS pos, CAST(e.embedding AS DOUBLE[]) AS vec
        FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)
  GROUP BY key)"""


def _first_match_sql(src: str, id_col: str, text_col: str, lookup: str = LOOKUP_SQL) -> str:
    return f"""(WITH q AS (SELECT {id_col} AS qid, {norm(text_col)} AS n FROM {src}),
  lk AS {lookup},
  ex AS (SELECT q.qid, lk.pos FROM q JOIN lk ON q.n = lk.key),
  ct AS (SELECT q.qid, min(lk.pos) AS pos FROM q JOIN lk ON contains(q.n, lk.key) OR contains(lk.key, q.n)
         GROUP BY q.qid)
  SELECT q.qid, coalesce(ex.pos, ct.pos) AS pos, ex.pos IS NOT NULL AS exact
  FROM q LEFT JOIN ex ON ex.qid = q.qid LEFT JOIN ct ON ct.qid = q.qid)"""


@query("lookup_build", sql=f"""
SELECT md5(key) AS key_md5, pos, {', '.join(f'round(vec[{i + 1}], 6) AS INTN{i + 1}' for i in range(N_CONTROLS))}
FROM {LOOKUP_SQL}""")
def lookup_build(spark, sf):
    lk = benchmark_lookup(spark, sf)
    return lk.select(F.md5("key").alias("key_md5"), "pos",
                     *[F.round(F.col("vec")[i], 6).alias(f"INTN{i + 1}") for i in range(N_CONTROLS)])


@query("match_exact", sql=f"""
SELECT d.doc_id, lk.pos FROM documents d LEFT JOIN {LOOKUP_SQL} lk ON {norm('d.text')} = lk.key""")
def match_exact(spark, sf):
    hashes = lambda c: [h.alias(f"_k{i}") for i, h in enumerate(text_key(c), 1)]
    lk = benchmark_lookup(spark, sf).select(*hashes(F.col("key")), "pos")
    d = load_table(spark, sf, "documents").select("doc_id", *hashes(normalize_text("text")))
    return d.join(lk, ["_k1", "_k2"], "left").select("doc_id", "pos")


@query("match_contains", sql=f"""
SELECT qid AS doc_id, pos, CASE WHEN pos IS NULL THEN NULL ELSE exact END AS exact
FROM {_first_match_sql('documents', 'doc_id', 'text')}""")
def match_contains(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    return match_column(d, "text", benchmark_lookup(spark, sf), keep=["doc_id"]).select("doc_id", "pos", "exact")


def _enriched_doc_pairs(spark, sf):
    """Each document (base) with the next document id (comparison)."""
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    return enrich_neighbours(d, "doc_id", "text", benchmark_lookup(spark, sf), N_CONTROLS)


def pairs_match_sql(lookup: str = LOOKUP_SQL) -> str:
    return f"""(WITH p AS (SELECT a.doc_id AS pair_id, a.text AS tb, b.text AS tc
                FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
  mb AS {_first_match_sql('p', 'pair_id', 'tb', lookup)},
  mc AS {_first_match_sql('p', 'pair_id', 'tc', lookup)},
  lk AS {lookup}
  SELECT p.pair_id, p.tb, p.tc, lb.vec AS bv, lc.vec AS cv,
         mb.pos IS NOT NULL AS base_matched, mc.pos IS NOT NULL AS comp_matched
  FROM p JOIN mb ON mb.qid = p.pair_id JOIN mc ON mc.qid = p.pair_id
  LEFT JOIN lk lb ON lb.pos = mb.pos LEFT JOIN lk lc ON lc.pos = mc.pos)"""


_PAIRS_MATCH_SQL = pairs_match_sql()


@query("match_rates", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS n,
       CAST(count_if(base_matched) AS BIGINT) AS matched_base,
       CAST(count_if(comp_matched) AS BIGINT) AS matched_comp,
       CAST(count_if(base_matched AND comp_matched) AS BIGINT) AS matched_both,
       CASE WHEN count(*) > 0 THEN round(100.0 * count_if(base_matched) / count(*), 4) END AS pct_base,
       CASE WHEN count(*) > 0 THEN round(100.0 * count_if(comp_matched) / count(*), 4) END AS pct_comp,
       CASE WHEN count(*) > 0 THEN round(100.0 * count_if(base_matched AND comp_matched) / count(*), 4) END AS pct_both
FROM {_PAIRS_MATCH_SQL}""")
def match_rates_q(spark, sf):
    return match_rates(_enriched_doc_pairs(spark, sf))


@query("vector_diff", sql=f"""
SELECT pair_id,
       {', '.join(f'round(CASE WHEN base_matched AND comp_matched THEN cv[{i + 1}] - bv[{i + 1}] ELSE 0.0 END, 6) AS INTN{i + 1}' for i in range(N_CONTROLS))},
       base_matched AND comp_matched AS nuisance_matched,
       {wc('tb')} AS wc_base, {wc('tc')} AS wc_comparison, {wc('tc')} - {wc('tb')} AS wc_diff
FROM {_PAIRS_MATCH_SQL}""")
def vector_diff(spark, sf):
    e = _enriched_doc_pairs(spark, sf)
    return e.select("pair_id", *[F.round(f"INTN{i + 1}", 6).alias(f"INTN{i + 1}") for i in range(N_CONTROLS)],
                    "nuisance_matched", "wc_base", "wc_comparison", "wc_diff")
