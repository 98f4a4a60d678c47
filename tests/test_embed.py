"""Embeddings: residual orthogonality, Gram against NumPy, SVD controls, metrics."""

import numpy as np
from pyspark.sql import functions as F

from textcontrols.operators import embed as E

SF = "/root/testdata/sf0.001"


def _emb(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def test_residual_orthogonal_and_gram(spark):
    e = _emb(spark)
    r = E.residualize(e.select("vec_id", "label", "embedding"), E.class_centroids(e, "label"), "label")
    pdf = r.select("label", "residual").toPandas()
    X = np.vstack(pdf["residual"].to_numpy())
    for lab in pdf["label"].unique():  # every residual dim sums to 0 within each class
        assert np.abs(X[pdf["label"].to_numpy() == lab].sum(axis=0)).max() < 1e-9
    d = X.shape[1]
    g = E.gram_to_numpy(E.gram_rows(r.repartition(5), "residual"))
    assert g.shape == (d, d)
    assert np.abs(g - X.T @ X).max() < 1e-8


def test_svd_controls_match_numpy(spark):
    e = _emb(spark).select("vec_id", "label", "embedding")
    out, sigma, k = E.nuisance_controls(spark, e, "label", k=3)
    pdf = E.residualize(e, E.class_centroids(_emb(spark), "label"), "label").toPandas().sort_values("vec_id")
    X = np.vstack(pdf["residual"].to_numpy())
    s_np = np.linalg.svd(X, compute_uv=False)
    assert np.allclose(sigma[:5], s_np[:5], rtol=1e-8)
    # projectors agree (signs and rotations of near-equal values do not matter)
    scores = out.orderBy("vec_id").select("INTN1", "INTN2", "INTN3").toPandas().to_numpy()
    u, s, vt = np.linalg.svd(X, full_matrices=False)
    p_ours = scores @ np.linalg.pinv(scores)
    p_np = u[:, :3] @ u[:, :3].T
    assert np.abs(p_ours - p_np).max() < 1e-6


def test_elbow_index():
    assert E.elbow_index([10, 9, 8, 2, 1.5, 1, 0.5]) == 3


def test_metrics_perfect_and_imperfect(spark):
    df = spark.createDataFrame([(0, 0, True), (0, 0, True), (1, 1, True), (1, 0, False)],
                               "label int, prediction int, in_top5 boolean")
    r = E.classification_metrics(df, num_classes=2).collect()[0]
    assert r.accuracy == 0.75 and r.num_samples == 4 and r.top_5_accuracy == 0.75
    # class 0: p=2/3 r=1 f1=0.8; class 1: p=1 r=0.5 f1=2/3
    assert abs(r.macro_f1 - (0.8 + 2 / 3) / 2) < 1e-12


def test_residualize_attributes_orthogonal_to_all_dummies(spark):
    e = _emb(spark).select("vec_id", "label", "embedding",
                           F.when(F.col("embedding")[0] >= 0, "pos").otherwise("neg").alias("s"))
    pdf = E.residualize_attributes(e, ["label", "s"]).select("label", "s", "residual").toPandas()
    X = np.vstack(pdf["residual"].to_numpy())
    for col in ("label", "s"):
        for lv in pdf[col].unique():
            assert np.abs(X[pdf[col].to_numpy() == lv].sum(axis=0)).max() < 1e-8
    # one attribute: equals the class-mean residual
    one = E.residualize_attributes(e, ["label"]).orderBy("vec_id").select("residual").toPandas()
    ref = E.residualize(e, E.class_centroids(e, "label"), "label").orderBy("vec_id").select("residual").toPandas()
    assert np.abs(np.vstack(one["residual"]) - np.vstack(ref["residual"])).max() < 1e-9


def test_blocks_of_classes_equal_one_block(spark):
    e = _emb(spark).select("vec_id", "label", "embedding")
    model = E.centroid_model(E.class_centroids(e, "label"))
    want = sorted((r.vec_id, r.prediction, r.true_rank) for r in E.nearest_centroid(e, model, "label").collect())
    got = sorted((r.vec_id, r.prediction, r.true_rank) for r in E.nearest_centroid(
        e, model, "label", id_col="vec_id", block_bytes=3 * 8 * model[1].shape[1]).collect())  # 3 classes per block
    assert got == want


def test_prefix_hits_equal_a_scoring_for_each_size(spark):
    e = _emb(spark).select("vec_id", "label", "embedding")
    model = E.centroid_model(E.class_centroids(e, "label"))
    sizes = (32, 1, 64, 7)  # in any order
    out = E.nearest_by_prefix(e, model, "label", sizes)
    got = {r.vec_id: r.hits for r in out.collect()}
    for i, m in enumerate(sizes):
        want = {r.vec_id: r.prediction == r.label for r in E.nearest_centroid(e, model, "label", m=m).collect()}
        assert {k: v[i] for k, v in got.items()} == want
    assert out.where("false").collect() == []
    unknown = e.withColumn("label", F.lit(-5).cast(e.schema["label"].dataType)).limit(3)
    assert all(not any(r.hits) for r in E.nearest_by_prefix(unknown, model, "label", sizes).collect())
    plan = out.select("hits")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
