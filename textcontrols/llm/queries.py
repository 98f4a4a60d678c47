"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from textcontrols.llm import (
    bpe, embedding_dedup, exact_dedup, filter_audit, html_extraction, licenses, line_dedup, merkle, ngram_join, packing, quality_classifier,
    quality_rules, secrets,
)
from textcontrols.sources.tables import load_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_html_extraction")
def op1(spark, sf_dir):
    return html_extraction.extract(load_table(spark, sf_dir, "pages"))


@query("op2_packing")
def op2(spark, sf_dir):
    return packing.pack(load_table(spark, sf_dir, "documents"), TOKENIZER, PATTERN)


@query("op3_exact_dedup", """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t""")
def op3(spark, sf_dir):
    return exact_dedup.dedup(load_table(spark, sf_dir, "documents"))


@query("op5_bpe")
def op5(spark, sf_dir):
    return bpe.round_trip(load_table(spark, sf_dir, "documents"), RANKS, PATTERN)


@query("op6_license_scan")
def op6(spark, sf_dir):
    found = licenses.scan(load_table(spark, sf_dir, "documents"))
    said = F.transform("findings", lambda x: F.concat_ws(
        ":", x["license"], x["start"], x["end"], x["saving_pct"], x["wording_pct"], x["differences"]))
    return found.select("doc_id", "n_blocks", F.size("findings").cast("long").alias("n_findings"),
                        F.array_join("licenses", ",").alias("licenses"), F.array_join(said, "\n").alias("findings"))


@query("op7_quality_rules")
def op7(spark, sf_dir):
    return quality_rules.rate(load_table(spark, sf_dir, "documents"))


@query("op9_secret_scan")
def op9(spark, sf_dir):
    return secrets.scan(load_table(spark, sf_dir, "documents"), RANKS, PATTERN)


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    return quality_classifier.classify(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


@query("op8_ngram_join")
def op8(spark, sf_dir):
    return ngram_join.join_components(load_table(spark, sf_dir, "documents"), words=3, pct=90).drop("text_key")


@query("op4_line_dedup")
def op4(spark, sf_dir):
    found = line_dedup.dedup(load_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("left").alias("text"), "n_lines", "n_removed_lines")


#: Unsigned CRC-32 of a decimal number, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::UBIGINT)),
      lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT)"""


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@query("op11_merkle", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low AS (
  SELECT g, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM low WHERE n > 1 GROUP BY g, lvl, pos // 16),
sub AS (SELECT g, h AS subroot, lvl AS height FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, g AS pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM high WHERE n > 1 GROUP BY lvl, pos // 16),
node AS (
  SELECT g AS part, lvl, pos, h, n FROM low
  UNION ALL SELECT NULL, lvl, pos, h, n FROM high),
way AS (
  SELECT l.g, l.pos, n.lvl AS step, n.pos AS place, n.h, n.pos = (l.pos >> (4 * n.lvl)) AS own
  FROM leaves l JOIN node n ON n.part = l.g AND n.n > 1 AND n.pos // 16 = (l.pos >> (4 * n.lvl)) // 16
  UNION ALL
  SELECT l.g, l.pos, s.height + n.lvl, n.pos, n.h, n.pos = (l.g >> (4 * n.lvl))
  FROM leaves l JOIN sub s ON s.g = l.g JOIN node n ON n.part IS NULL AND n.n > 1 AND n.pos // 16 = (l.g >> (4 * n.lvl)) // 16),
proof AS (
  SELECT g, pos, sha256(coalesce(string_agg(CASE WHEN NOT own THEN h END, '' ORDER BY step, place), '')) AS proof_sha256, max(step) AS last FROM way GROUP BY g, pos),
folded AS (
  SELECT g, pos, 0 AS step, coalesce(changed, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.g, f.pos, f.step + 1, sha256(string_agg(CASE WHEN w.own THEN f.h ELSE w.h END, '' ORDER BY w.place))
  FROM folded f JOIN way w ON w.g = f.g AND w.pos = f.pos AND w.step = f.step GROUP BY f.g, f.pos, f.step),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM leaves l JOIN sub s ON s.g = l.g CROSS JOIN root r LEFT JOIN proof p ON p.g = l.g AND p.pos = l.pos
JOIN folded f ON f.g = l.g AND f.pos = l.pos AND f.step = coalesce(p.last + 1, 0)""")
def op11(spark, sf_dir):
    return merkle.audit(load_table(spark, sf_dir, "documents"))


@query("op12_filter_audit", """
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN min(w.doc_id) OVER (PARTITION BY t) < w.doc_id THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN said ON said.doc_id = w.doc_id),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM m GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31),
steps AS (
  SELECT filter_order, s.step, (SELECT bit FROM l WHERE c = filter_order[s.step]) AS own,
         coalesce((SELECT sum(bit) FROM l WHERE instr(filter_order, c) < s.step), 0)::INTEGER AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (WHERE mask & (own | earlier) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & own <> 0), 0)::BIGINT AS shapley
FROM h, steps GROUP BY part, filter_order, step""")
def op12(spark, sf_dir):
    return filter_audit.audit(spark, f"{sf_dir.rstrip('/')}/documents.parquet", load_table(spark, sf_dir, "labels"))


@query("op13_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def op13(spark, sf_dir):
    return embedding_dedup.dedup(load_table(spark, sf_dir, "embeddings"))
