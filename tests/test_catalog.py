"""Catalog: running index, assembly, design check, merge, worklist."""

from pyspark.sql import functions as F

from textcontrols.operators import catalog as C


def _cat(spark):
    rows = [(f"b{k}", k, f"text {k}", "t", "p") for k in (5, 70000, 3, 200000)]
    return spark.createDataFrame(rows, "description_id string, key long, description string, treatment string, profile string")


def test_dense_index_of_sparse_keys(spark):
    out = C.dense_index(_cat(spark), "key").orderBy("key").select("key", "_pos").collect()
    assert [(r.key, r._pos) for r in out] == [(3, 0), (5, 1), (70000, 2), (200000, 3)]


def test_expand_running_index_and_design(spark):
    cat = C.dense_index(_cat(spark), "key").withColumnRenamed("_pos", "base_pos")
    x = C.expand_variations(cat, C.STRATEGIES, n=4)
    ids = {r.augmented_id for r in x.collect()}
    assert len(ids) == 4 * 3 * 4 and "b3_summarize_0" in ids and "b200000_elaborate_47" in ids
    gen = x.select("augmented_id", F.col("description_id").alias("base_description_id"), "strategy",
                   F.concat(F.col("strategy"), F.lit(": "), F.col("description")).alias("description"))
    a = C.assemble(_cat(spark), gen, "description_id", ["treatment", "profile"])
    assert a.count() == 4 * 13 and a.where("is_original").count() == 4
    want = C.expected_cells(_cat(spark), "description_id", ["treatment", "profile"], n=4)
    d = {(r.check, r.cell): r for r in C.design_check(a, want, ["treatment", "profile"], 13).collect()}
    assert all(r.ok for r in d.values()) and d["strategy", "original"].observed == 4 and d["attributes", "t|p"].expected == 52
    # an unknown strategy of the same size: the missing one and the unexpected one both show
    odd = a.withColumn("augmentation_strategy", F.when(F.col("augmentation_strategy") == "paraphrase", "zzz")
                       .otherwise(F.col("augmentation_strategy")))
    d = {(r.check, r.cell): r for r in C.design_check(odd, want, ["treatment", "profile"], 13).collect()}
    assert (d["strategy", "zzz"].observed, d["strategy", "zzz"].expected, d["strategy", "zzz"].ok) == (16, 0, False)
    assert (d["strategy", "paraphrase"].observed, d["strategy", "paraphrase"].ok) == (0, False)
    # an attribute cell of the wrong size
    few = a.where("base_description_id <> 'b3'")
    assert not {(r.check, r.cell): r for r in C.design_check(few, want, ["treatment", "profile"], 13).collect()}["attributes", "t|p"].ok


def test_distinct_requests_and_fill(spark):
    cat = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", "other")], "description_id string, description string")
    req = C.distinct_requests(cat, n=2)
    assert req.count() == 2 * 3 * 2 and {r.n_bases for r in req.where("description = 'same'").collect()} == {2}
    cache = req.where("description = 'same'").select("request_hash", F.lit("hit").alias("response"))
    assert C.worklist(req, cache).count() == 6 and {r.response for r in C.fill_from_cache(req, cache).collect()} == {"hit"}


def test_merge_right_wins(spark):
    left = spark.createDataFrame([("a", "L1"), ("b", "L2")], "k string, v string")
    right = spark.createDataFrame([("b", "R2"), ("c", "R3")], "k string, v string")
    out = {r.k: (r.v, r.from_right) for r in C.merge_catalogs(left, right, "k").collect()}
    assert out == {"a": ("L1", False), "b": ("R2", True), "c": ("R3", True)}


def test_worklist_anti_join(spark):
    req = spark.createDataFrame([("x", 1), ("y", 2)], "s string, v int").withColumn("request_hash", C.request_hash("s", "v"))
    cache = req.where("s = 'x'").select("request_hash")
    assert [r.s for r in C.worklist(req, cache).collect()] == ["y"]


def test_holdout_fold_of_large_ids(spark):
    from textcontrols.operators.embed import holdout_fold
    df = spark.createDataFrame([(x,) for x in (0, 4_000_000_000, 9_223_372_036_854_775_807, -5)], "i long")
    assert all(0 <= r[0] < 10 for r in df.select(holdout_fold("i", 3)).collect())
