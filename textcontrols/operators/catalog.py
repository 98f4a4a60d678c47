"""Stimulus catalog: expansion into strategy x variation requests, worklists, assembly, merge, design check.

The running index of a generated row is arithmetic on the base's position
in catalog order, the strategy's position and the variation number, so no
window ever spans the whole expanded table.  The base position is a
distributed dense index: key buckets of bounded width, bucket offsets from a
small count table, then a row number inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.operators._util import dense_rank_by, materialize_small

# Strategy names, sampling temperatures and token limits, in strategy order.
STRATEGIES = (
    ("summarize", 0.4, 80),
    ("paraphrase", 0.5, 150),
    ("elaborate", 0.6, 250),
)
# Fixed value: variations per strategy and base text.
N_VARIATIONS = 50
ORIGINAL = "original"

def strategies_column(strategies=STRATEGIES):
    """The strategies as one literal array of structs (position, name, temperature, max tokens).

    What a strategy asks for is the caller's: an instruction column of the
    catalog, named in the fields of the request hash.
    """
    return F.array(*[F.struct(F.lit(i).alias("strategy_pos"), F.lit(n).alias("strategy"),
                              F.lit(float(t)).alias("temperature"), F.lit(int(m)).alias("max_tokens"))
                     for i, (n, t, m) in enumerate(strategies)])


def dense_index(df: DataFrame, key: str, out: str = "_pos") -> DataFrame:
    """Adds ``_pos``: 0-based position of each row in ascending order of a unique ``key``, however sparse.

    Range partitions hold sorted slices; their offsets come from one count for
    each partition.
    """
    return dense_rank_by(df.withColumn("_all", F.lit(0)), "_all", key, out).drop("_all")


def expand_variations(catalog: DataFrame, strategies=STRATEGIES, key: str = "description_id",
                      order_key: str = "base_pos", n: int = N_VARIATIONS) -> DataFrame:
    """base x strategy x variation requests with id ``{base}_{strategy}_{i}``.

    ``i`` is the running index over (base position, strategy position,
    variation) computed arithmetically.  Strategies and variations are
    generated per base row by ``explode`` (a literal array and a sequence):
    no join, no shuffle, every task expands only its own bases.
    """
    n_s = len(strategies)
    x = catalog.withColumn("_s", F.explode(strategies_column(strategies))).select("*", "_s.*").drop("_s")
    x = x.withColumn("variation", F.explode(F.sequence(F.lit(1), F.lit(n))))
    i = F.col(order_key) * (n_s * n) + F.col("strategy_pos") * n + F.col("variation") - 1
    return x.withColumn("running_index", i.cast("long")).withColumn(
        "augmented_id", F.concat_ws("_", F.col(key), F.col("strategy"), i.cast("string")))


def request_hash(*cols) -> F.Column:
    """SHA-256 over the fields that define a generation request (cache key)."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def distinct_requests(catalog: DataFrame, text_col: str = "description", strategies=STRATEGIES,
                      n: int = N_VARIATIONS, fields: Sequence[str] = ()) -> DataFrame:
    """One row per distinct request: text, ``fields``, strategy, variation, request_hash, n_bases.

    Equal texts are collapsed before the expansion, so each request is made and
    hashed once; ``n_bases`` is the number of catalog rows that wait for it.
    """
    texts = catalog.groupBy(text_col, *fields).agg(F.count(F.lit(1)).alias("n_bases"))
    x = texts.withColumn("_s", F.explode(strategies_column(strategies))).select("*", "_s.*").drop("_s")
    x = x.withColumn("variation", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return x.withColumn("request_hash", request_hash("strategy", *fields, text_col, "variation"))


def worklist(requests: DataFrame, cache: DataFrame, hash_col: str = "request_hash") -> DataFrame:
    """Requests with no cached response (anti-join on the request hash)."""
    return requests.join(cache.select(hash_col), hash_col, "left_anti")


def fill_from_cache(requests: DataFrame, cache: DataFrame, hash_col: str = "request_hash",
                    text_col: str = "response") -> DataFrame:
    """Requests with a cached response and that response."""
    return requests.join(cache.select(hash_col, text_col), hash_col)


def originals(catalog: DataFrame, key: str, attrs: Sequence[str], text_col: str = "description") -> DataFrame:
    """The catalog's own texts in the layout of the assembled table."""
    return catalog.select(F.col(text_col).alias("description"), F.col(key).alias("augmented_id"),
                          F.col(key).alias("base_description_id"), *attrs,
                          F.lit(ORIGINAL).alias("augmentation_strategy"), F.lit(True).alias("is_original"))


def assemble(catalog: DataFrame, generated: DataFrame, key: str, attrs: Sequence[str],
             text_col: str = "description") -> DataFrame:
    """Generated rows joined to their base attributes, plus the originals (is_original)."""
    base = catalog.select(F.col(key).alias("base_description_id"), *attrs)
    gen = generated.join(base, "base_description_id", "inner").select(
        F.col(text_col).alias("description"), "augmented_id", "base_description_id", *attrs,
        F.col("strategy").alias("augmentation_strategy"), F.lit(False).alias("is_original"))
    return gen.unionByName(originals(catalog, key, attrs, text_col))


def canonical_ids(df: DataFrame, id_col: str = "description_id",
                  base_col: str = "base_description_id") -> DataFrame:
    """Overwrite the id with the base id when the frame has one (augmented rows share their base's id)."""
    return df.withColumn(id_col, F.col(base_col)) if base_col in df.columns else df


def merge_catalogs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union by key; where both sides hold a key the right side wins (one row per key)."""
    cols = [c for c in left.columns if c != key]
    both = (left.select(key, F.struct(*cols).alias("_v"), F.lit(0).alias("_side"))
            .unionByName(right.select(key, F.struct(*cols).alias("_v"), F.lit(1).alias("_side"))))
    return both.groupBy(key).agg(F.max_by("_v", "_side").alias("_v"), F.max("_side").alias("from_right")) \
        .select(key, "_v.*", (F.col("from_right") == 1).alias("from_right"))


def cell_name(cols: Sequence[str]):
    """The values of a cell's columns as one name; a null is shown as such."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols])


def expected_cells(catalog: DataFrame, key: str, attrs: Sequence[str], strategies=STRATEGIES,
                   n: int = N_VARIATIONS) -> DataFrame:
    """(check, cell, expected) of a full design: rows per strategy and originals, rows per cell of ``attrs``, no odd base."""
    per_base = len(strategies) * n + 1
    bases = catalog.agg(F.count(F.lit(1)).alias("b"))
    cells = F.explode(F.array(*[F.struct(F.lit("strategy").alias("check"), F.lit(name).alias("cell"),
                                         (F.col("b") * k).alias("expected"))
                                for name, k in [*((s[0], n) for s in strategies), (ORIGINAL, 1)]],
                              F.struct(F.lit("base").alias("check"), F.lit("mismatched").alias("cell"),
                                       (F.col("b") * 0).alias("expected"))))
    by_attrs = catalog.groupBy(cell_name(attrs).alias("cell")).agg((F.count(F.lit(1)) * per_base).alias("expected"))
    return (bases.select(cells.alias("_c")).select("_c.*")
            .unionByName(by_attrs.select(F.lit("attributes").alias("check"), "cell", "expected")))


def design_check(assembled: DataFrame, expected: DataFrame, attrs: Sequence[str], per_base: int) -> DataFrame:
    """Observed against expected rows of every cell: check, cell, observed, expected, ok.

    A cell that is missing, or that nobody expects, has a row of its own (full
    outer join with 0).  One pass over the rows counts (base, strategy,
    attributes); all checks read that table.
    """
    cells = materialize_small(assembled.groupBy("base_description_id", "augmentation_strategy", cell_name(attrs).alias("_a"))
                              .agg(F.count(F.lit(1)).alias("c")))

    def check(name, cell):
        return cells.groupBy(cell.alias("cell")).agg(F.sum("c").alias("observed")).select(F.lit(name).alias("check"), "cell", "observed")

    odd = (cells.groupBy("base_description_id").agg(F.sum("c").alias("c"))
           .agg(F.count_if(F.col("c") != per_base).alias("observed"))
           .select(F.lit("base").alias("check"), F.lit("mismatched").alias("cell"), "observed"))
    seen = (check("strategy", F.coalesce("augmentation_strategy", F.lit("<null>")))
            .unionByName(check("attributes", F.col("_a"))).unionByName(odd))
    both = seen.join(expected, ["check", "cell"], "full")
    both = both.select("check", "cell", F.coalesce("observed", F.lit(0)).cast("long").alias("observed"),
                       F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    return both.withColumn("ok", F.col("observed") == F.col("expected"))
