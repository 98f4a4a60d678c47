"""Queries: truncation, centroids, nearest-centroid classification, metrics, sweep, split, residual controls."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from textcontrols.operators import embed as E
from textcontrols.operators.level_effects import residualize_levels
from textcontrols.operators.tsqr import singular_vectors
from textcontrols.plans.registry import query
from textcontrols.sources.tables import load_table

# Fixed parameters: truncation sizes searched, top-k, hold-out seed and folds.
SWEEP = (16, 32, 64)
TOPK = 5
SEED = 42
FOLDS = 10


def _emb(spark, sf):
    return load_table(spark, sf, "embeddings")


EXPLODED_SQL = """(SELECT vec_id, label, CAST(v AS DOUBLE) AS v, CAST(i - 1 AS BIGINT) AS dim
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
CENTROIDS_SQL = f"(SELECT label, dim, avg(v) AS centroid, CAST(count(*) AS BIGINT) AS n FROM {EXPLODED_SQL} GROUP BY label, dim)"


def _dists_sql(m: int | None = None) -> str:
    cond = f" AND x.dim < {m}" if m else ""
    return f"""(SELECT x.vec_id, x.label, c.label AS cls, sum((x.v - c.centroid) * (x.v - c.centroid)) AS dist
  FROM {EXPLODED_SQL} x JOIN {CENTROIDS_SQL} c ON c.dim = x.dim{cond} GROUP BY x.vec_id, x.label, c.label)"""


def _ranked_sql(m: int | None = None) -> str:
    return f"""(SELECT vec_id, label,
       max(CASE WHEN rn = 1 THEN cls END) AS prediction,
       CAST(max(CASE WHEN cls = label THEN rn END) AS INTEGER) AS true_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cls) AS rn FROM {_dists_sql(m)})
  GROUP BY vec_id, label)"""


@query("embedding_truncate", sql=f"""
SELECT x.vec_id, CAST(ms.m AS INTEGER) AS m, round(sum(x.v * x.v), 6) AS sq_norm
FROM {EXPLODED_SQL} x JOIN (SELECT unnest([16, 32, 64]) AS m) ms ON x.dim < ms.m
GROUP BY x.vec_id, ms.m""")
def embedding_truncate(spark, sf):
    e = _emb(spark, sf).select("vec_id", "embedding", F.explode(F.array(*[F.lit(m) for m in SWEEP])).alias("m"))
    t = F.transform(F.slice("embedding", 1, F.col("m")), lambda x: x.cast("double"))
    sq = F.aggregate(t, F.lit(0.0), lambda acc, x: acc + x * x)
    return e.select("vec_id", "m", F.round(sq, 6).alias("sq_norm"))


@query("class_centroids", sql=f"SELECT label, dim, round(centroid, 6) AS centroid, n FROM {CENTROIDS_SQL}")
def class_centroids(spark, sf):
    c = E.class_centroids(_emb(spark, sf), "label")
    return c.select("label", F.col("dim").cast("long").alias("dim"), F.round("centroid", 6).alias("centroid"), "n")


def _classified(spark, sf, m=None):
    e = _emb(spark, sf)
    model = E.centroid_model(E.class_centroids(e, "label"))
    return E.nearest_centroid(e.select("vec_id", "label", "embedding"), model, "label", m=m, k=TOPK,
                              id_col="vec_id")


@query("centroid_classify", sql=f"SELECT vec_id, label, prediction, true_rank FROM {_ranked_sql()}")
def centroid_classify(spark, sf):
    return _classified(spark, sf).select("vec_id", "label", "prediction", "true_rank")


@query("classification_metrics", sql=f"""
WITH p AS {_ranked_sql()},
 sup AS (SELECT label AS cls, count(*) AS support FROM p GROUP BY label),
 prd AS (SELECT prediction AS cls, count(*) AS predicted FROM p GROUP BY prediction),
 tp AS (SELECT label AS cls, count(*) AS tp FROM p WHERE label = prediction GROUP BY label),
 per AS (SELECT cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
         FROM sup FULL JOIN prd USING (cls) LEFT JOIN tp USING (cls)),
 f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per),
 g AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM f)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
       CAST(count_if(support > 0) AS BIGINT) AS num_classes_in_data, CAST(sum(support) AS BIGINT) AS num_samples,
       (SELECT round(avg(CASE WHEN true_rank <= {TOPK} THEN 1.0 ELSE 0.0 END), 6) FROM p) AS top_5_accuracy,
       (SELECT CAST(count(DISTINCT label) AS BIGINT) FROM embeddings) AS num_classes
FROM g""")
def classification_metrics(spark, sf):
    e = _emb(spark, sf)
    model = E.centroid_model(E.class_centroids(e, "label"))
    pred = E.nearest_centroid(e.select("vec_id", "label", "embedding"), model, "label", k=TOPK, id_col="vec_id")
    out = E.classification_metrics(pred, "label", "prediction", len(model[0]), f"in_top{TOPK}")
    return out.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "top_5_accuracy")],
                      F.col("num_classes_in_data").cast("long").alias("num_classes_in_data"),
                      F.col("num_samples").cast("long").alias("num_samples"), "num_classes")


@query("topk_accuracy", sql=f"""
SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN true_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1,
       round(avg(CASE WHEN true_rank <= {TOPK} THEN 1.0 ELSE 0.0 END), 6) AS top5
FROM {_ranked_sql()} GROUP BY label""")
def topk_accuracy(spark, sf):
    p = _classified(spark, sf)
    return p.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("true_rank") == 1).cast("double")), 6).alias("top1"),
        F.round(F.avg(F.col(f"in_top{TOPK}").cast("double")), 6).alias("top5"))


@query("truncation_sweep", sql=f"""
SELECT m, accuracy, CAST(rank() OVER (ORDER BY accuracy DESC, m) AS INTEGER) AS rank FROM (
""" + " UNION ALL ".join(
    f"SELECT {m} AS m, round(avg(CASE WHEN true_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_ranked_sql(m)}"
    for m in SWEEP) + ")")
def truncation_sweep(spark, sf):
    e = _emb(spark, sf).select("vec_id", "label", "embedding")
    model = E.centroid_model(E.class_centroids(e, "label"))  # full centroids; truncation = first m dims
    hits = E.nearest_by_prefix(e, model, "label", SWEEP).select("hits")
    per = hits.select(F.explode(F.arrays_zip(F.array(*[F.lit(m) for m in SWEEP]).alias("m"), F.col("hits").alias("ok"))).alias("x"))
    per = per.select(F.col("x.m").alias("m"), F.col("x.ok").cast("double").alias("ok"))
    acc = per.groupBy("m").agg(F.round(F.avg("ok"), 6).alias("accuracy"))
    # a window over one row per m (3 rows), not over data rows
    return acc.select("m", "accuracy", F.rank().over(Window.orderBy(F.desc("accuracy"), "m")).alias("rank"))


@query("holdout_split", sql=f"""
SELECT label, CAST(count_if(fold <> 0) AS BIGINT) AS n_train, CAST(count_if(fold = 0) AS BIGINT) AS n_test
FROM (SELECT label, ((vec_id % 2147483648 + 2147483648) % 2147483648 * 2654435761 + {SEED}) % {FOLDS} AS fold FROM embeddings)
GROUP BY label""")
def holdout_split(spark, sf):
    f = _emb(spark, sf).select("label", E.holdout_fold("vec_id", SEED, FOLDS).alias("fold"))
    return f.groupBy("label").agg(F.count_if(F.col("fold") != 0).alias("n_train"),
                                  F.count_if(F.col("fold") == 0).alias("n_test"))


RESID_SQL = f"""(SELECT x.vec_id, x.dim, x.v - c.centroid AS r FROM {EXPLODED_SQL} x
  JOIN {CENTROIDS_SQL} c ON c.label = x.label AND c.dim = x.dim)"""


@query("residual_embedding", sql=f"SELECT vec_id, round(sum(r * r), 6) AS sq_norm FROM {RESID_SQL} GROUP BY vec_id")
def residual_embedding(spark, sf):
    e = _emb(spark, sf)
    r = E.residualize(e.select("vec_id", "label", "embedding"), E.class_centroids(e, "label"), "label")
    return r.select("vec_id", F.round(F.aggregate("residual", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sq_norm"))


@query("residual_gram", sql=f"""
SELECT a.dim AS i, b.dim AS j, round(sum(a.r * b.r), 6) AS g
FROM {RESID_SQL} a JOIN {RESID_SQL} b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim""")
def residual_gram(spark, sf):
    e = _emb(spark, sf)
    r = E.residualize(e.select("vec_id", "label", "embedding"), E.class_centroids(e, "label"), "label")
    return E.gram_matrix(r, "residual").withColumn("g", F.round("g", 6))


@query("nuisance_svd")
def nuisance_svd(spark, sf):
    e = _emb(spark, sf).select("vec_id", "label", "embedding")
    out, sigma, k = E.nuisance_controls(spark, e, "label")
    return out.select("vec_id", "label", *[F.round(f"INTN{j + 1}", 6).alias(f"INTN{j + 1}") for j in range(k)])


@query("svd_elbow")
def svd_elbow(spark, sf):
    e = _emb(spark, sf).select("vec_id", "label", "embedding")
    r = E.residualize(e, E.class_centroids(e, "label"), "label")
    sigma, _ = singular_vectors(r, "residual")
    k = E.elbow_index(sigma)
    total = float((sigma ** 2).sum()) or 1.0
    rows = [(i + 1, float(s), float(s * s / total), i + 1 <= k) for i, s in enumerate(sigma)]
    return spark.createDataFrame(rows, "component int, sigma double, explained double, selected boolean")


@query("svd_norms", sql=f"""
WITH g AS (SELECT a.dim AS i, b.dim AS j, sum(a.r * b.r) AS g FROM {RESID_SQL} a JOIN {RESID_SQL} b ON a.vec_id = b.vec_id
           GROUP BY a.dim, b.dim)
SELECT round(sum(CASE WHEN i = j THEN g ELSE 0 END), 4) AS sum_sigma2, round(sqrt(sum(g * g)), 4) AS norm_sigma2,
       round((SELECT sum(r * r) FROM {RESID_SQL}), 4) AS sum_scores2 FROM g""")
def svd_norms(spark, sf):
    """What SQL can say of the decomposition: the sum and the norm of the squared singular values, and that all
    scores together keep the squared length of the residuals."""
    e = _emb(spark, sf).select("vec_id", "label", "embedding")
    d = e.select(F.size("embedding")).first()[0]
    out, sigma, k = E.nuisance_controls(spark, e, "label", k=d)
    square = sum((F.col(f"INTN{j + 1}") * F.col(f"INTN{j + 1}") for j in range(k)), F.lit(0.0))
    return out.agg(F.round(F.lit(float((sigma ** 2).sum())), 4).alias("sum_sigma2"),
                   F.round(F.lit(float(np.sqrt((sigma ** 4).sum()))), 4).alias("norm_sigma2"),
                   F.round(F.sum(square), 4).alias("sum_scores2"))


@query("svd_tsqr", sql=f"""
SELECT a.dim AS i, b.dim AS j, round(sum(a.r * b.r), 6) AS g
FROM {RESID_SQL} a JOIN {RESID_SQL} b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim""")
def svd_tsqr(spark, sf):
    """The residuals' products of dimensions, put together again from singular values and vectors of the QR tree."""
    e = _emb(spark, sf)
    r = E.residualize(e.select("vec_id", "label", "embedding"), E.class_centroids(e, "label"), "label")
    sigma, v = singular_vectors(r, "residual")
    scaled = spark.createDataFrame([(row.tolist(),) for row in sigma[:, None] * v.T], "row array<double>")
    return E.gram_matrix(scaled, "row").withColumn("g", F.round("g", 6))


@query("residual_multi")
def residual_multi(spark, sf):
    """Residuals on two attributes jointly: label and the sign of the first dimension."""
    e = _emb(spark, sf).select("vec_id", "label", "embedding",
                               F.when(F.col("embedding")[0] >= 0, "pos").otherwise("neg").alias("sign0"))
    r = E.residualize_attributes(e, ["label", "sign0"])
    return r.select("vec_id", "label", "sign0",
                    F.round(F.aggregate("residual", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sq_norm"))


@query("residual_levels", sql="""
SELECT attribute, level, CAST(count(*) AS BIGINT) AS n, 0.0::DOUBLE AS largest_sum FROM (
  SELECT 'label' AS attribute, CAST(label AS VARCHAR) AS level FROM embeddings
  UNION ALL SELECT 'sign', CASE WHEN embedding[1] >= 0 THEN 'pos' ELSE 'neg' END FROM embeddings)
GROUP BY attribute, level""")
def residual_levels(spark, sf):
    """Residuals on two attributes by conjugate gradients: within every level each dimension sums to nothing."""
    e = _emb(spark, sf).select("vec_id", F.col("label").cast("string").alias("label"), "embedding",
                               F.when(F.col("embedding")[0] >= 0, "pos").otherwise("neg").alias("sign"))
    r = residualize_levels(e, ["label", "sign"])
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("level")) for a in ("label", "sign")]))
    long = r.select(at.alias("_at"), F.posexplode("residual").alias("dim", "v"))
    sums = long.groupBy("_at.attribute", "_at.level", "dim").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))
    return sums.groupBy("attribute", "level").agg(F.max("c").alias("n"), F.round(F.max(F.abs("s")), 5).alias("largest_sum"))


_FOLD_SQL = f"((vec_id % 2147483648 + 2147483648) % 2147483648 * 2654435761 + {SEED}) % {FOLDS}"
_TRAIN_CENTROIDS_SQL = f"""(SELECT label, dim, avg(v) AS centroid FROM {EXPLODED_SQL}
  WHERE {_FOLD_SQL} <> 0 GROUP BY label, dim)"""


@query("holdout_accuracy", sql=f"""
WITH d AS (SELECT x.vec_id, x.label, c.label AS cls, sum((x.v - c.centroid) * (x.v - c.centroid)) AS dist
           FROM {EXPLODED_SQL} x JOIN {_TRAIN_CENTROIDS_SQL} c ON c.dim = x.dim
           WHERE {_FOLD_SQL.replace('vec_id', 'x.vec_id')} = 0 GROUP BY x.vec_id, x.label, c.label),
p AS (SELECT vec_id, label, max(CASE WHEN rn = 1 THEN cls END) AS prediction,
             max(CASE WHEN cls = label THEN rn END) AS true_rank
      FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cls) AS rn FROM d) GROUP BY vec_id, label)
SELECT CAST(count(*) AS BIGINT) AS n_test, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(CASE WHEN true_rank <= {TOPK} THEN 1.0 ELSE 0.0 END), 6) AS top_5_accuracy FROM p""")
def holdout_accuracy(spark, sf):
    """Centroids from the training folds, nearest-centroid scores on the held-out fold."""
    e = _emb(spark, sf).withColumn("fold", E.holdout_fold("vec_id", SEED, FOLDS))
    model = E.centroid_model(E.class_centroids(e.where(F.col("fold") != 0), "label"))
    test = e.where(F.col("fold") == 0).select("vec_id", "label", "embedding")
    p = E.nearest_centroid(test, model, "label", k=TOPK, id_col="vec_id")
    return p.agg(F.count(F.lit(1)).alias("n_test"),
                 F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"),
                 F.round(F.avg(F.col(f"in_top{TOPK}").cast("double")), 6).alias("top_5_accuracy"))
