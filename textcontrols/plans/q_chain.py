"""Queries: the whole chain, embeddings -> residuals -> SVD controls -> lookup -> pairs -> models.

The decomposition's signs and the choice of basis among equal values are free,
so SQL checks what they leave alone: with all components, lengths and distances
of the control vectors are those of the residuals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textcontrols.operators import embed as E
from textcontrols.operators import regress as R
from textcontrols.operators._util import materialize_small
from textcontrols.operators.catalog import canonical_ids
from textcontrols.operators.match import build_lookup, enrich_neighbours
from textcontrols.plans.frames import N_CONTROLS
from textcontrols.plans.q_embed import RESID_SQL
from textcontrols.plans.q_match import pairs_match_sql
from textcontrols.plans.registry import query
from textcontrols.plans.sqltext import norm
from textcontrols.sources.tables import load_table

CONTROLS = [f"INTN{i + 1}" for i in range(N_CONTROLS)]
_VECTORS_SQL = f"(SELECT vec_id, list(r ORDER BY dim) AS vec FROM {RESID_SQL} GROUP BY vec_id)"
RESIDUAL_LOOKUP_SQL = f"""(SELECT key, min(pos) AS pos, max_by(vec, pos) AS vec
  FROM (SELECT {norm('b.text')} AS key, b.item_id AS pos, e.vec FROM benchmark b JOIN {_VECTORS_SQL} e ON e.vec_id = b.item_id)
  GROUP BY key)"""


def originals_table(spark, sf):
    """Originals with their attribute, text and controls: description_id, base_description_id, label, text, INTN1..k."""
    e = load_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    scored, _, _ = E.nuisance_controls(spark, e, "label", k=N_CONTROLS)
    b = load_table(spark, sf, "benchmark").select(F.col("item_id").alias("base_description_id"), "text",
                                                  F.concat(F.lit("o"), F.col("item_id")).alias("description_id"))
    rows = b.join(scored, b["base_description_id"] == scored["vec_id"])
    return canonical_ids(rows.select("description_id", "base_description_id", "text", "label", *CONTROLS))


def _square(names):
    return sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))


@query("originals_controls", sql=f"""
SELECT b.item_id AS description_id, e.label, round(list_sum(list_transform(v.vec, lambda x: x * x)), 6) AS squared_length
FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN {_VECTORS_SQL} v ON v.vec_id = b.item_id""")
def originals_controls(spark, sf):
    """Controls of the originals joined to their attribute; the id is the base's."""
    return originals_table(spark, sf).select("description_id", "label", F.round(_square(CONTROLS), 6).alias("squared_length"))


def chain_pairs(spark, sf):
    """Pairs of neighbouring documents with the differences of all computed controls."""
    lookup = build_lookup(originals_table(spark, sf), "text", "description_id", CONTROLS)
    docs = load_table(spark, sf, "documents").select("doc_id", "text")
    return enrich_neighbours(docs, "doc_id", "text", lookup, N_CONTROLS)


@query("chain_pairs", sql=f"""
SELECT pair_id, base_matched AND comp_matched AS nuisance_matched,
       round(CASE WHEN base_matched AND comp_matched THEN list_sum(list_transform(list_zip(cv, bv), lambda x: (x[1] - x[2]) * (x[1] - x[2])))
                  ELSE 0.0 END, 6) AS squared_distance
FROM {pairs_match_sql(RESIDUAL_LOOKUP_SQL)}""")
def chain_pairs_q(spark, sf):
    return chain_pairs(spark, sf).select("pair_id", "nuisance_matched", F.round(_square(CONTROLS), 6).alias("squared_distance"))


@query("chain_models")
def chain_models(spark, sf):
    """Comparison word count on base word count and the first two computed controls, per match flag (signs are free: no SQL)."""
    pairs = materialize_small(chain_pairs(spark, sf).select("nuisance_matched", "wc_base", "wc_comparison", *CONTROLS[:2]))
    one = R.fit_ols(pairs, ["nuisance_matched"], "wc_comparison", ["wc_base"], "wc")
    two = R.fit_ols(pairs.where("nuisance_matched"), ["nuisance_matched"], "wc_comparison", CONTROLS[:2], "controls_2")
    return one.unionByName(two)
