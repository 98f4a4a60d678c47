"""Representation operators over an embedding column (array of float).

Attribute representation = class centroids; classification = nearest
centroid; attribute-orthogonal controls = residuals after removing the class
means, their Gram matrix and their SVD, projected back onto the rows.

Plans: centroids come from one aggregate over ``posexplode`` (partial
aggregation leaves labels x dims rows per task).  The centroid model (labels x
dims numbers) goes to the workers in blocks of bounded bytes and is scored by
matrix operations on Arrow batches; no join, no literals.  The Gram matrix is
summed from one partial per split, row by row; singular values come from QR factors
(``tsqr``), of which one of d x d numbers reaches the driver; scores are matrix products.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcontrols.operators._util import materialize_small
from textcontrols.operators.tsqr import singular_vectors

# Largest block of a centroid model that one pass sends to the workers, in bytes.
BLOCK_BYTES = 128 << 20


def as_double(emb: str = "embedding", m: int | None = None):
    """Embedding as array<double>, optionally truncated to the first ``m`` dims."""
    e = F.col(emb)
    if m is not None:
        e = F.slice(e, 1, m)
    return F.transform(e, lambda x: x.cast("double"))


def class_centroids(df: DataFrame, label: str, emb: str = "embedding") -> DataFrame:
    """(label, dim, centroid, n) long table: per-class mean of each dimension (dim 0-based)."""
    x = df.select(F.col(label).alias("label"), F.posexplode(emb).alias("dim", "v"))
    return x.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("centroid"),
                                         F.count(F.lit(1)).alias("n"))


def centroid_vectors(centroids: DataFrame, label: str = "label") -> DataFrame:
    """(label, vec): the long centroid table as one vector per class."""
    return centroids.groupBy(F.col("label").alias(label)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "centroid"))), lambda x: x["centroid"]).alias("_cvec"))


def centroid_model(centroids: DataFrame) -> tuple[list, np.ndarray]:
    """The model on the driver: labels in order and their vectors (labels x dims numbers, a summary of the classes)."""
    table = centroid_vectors(centroids).toArrow()
    labels = table.column("label").to_pylist()
    order = sorted(range(len(labels)), key=lambda i: labels[i])
    vectors = np.array(table.column("_cvec").to_pylist(), np.float64).reshape(len(labels), -1)
    return [labels[i] for i in order], vectors[order]


def _block_scores(labels: list, vectors: np.ndarray, kind: T.DataType, m: int | None):
    """Arrow function (embedding, label, true distance or null) -> best distance, its label, classes before the true one."""
    from pyspark.sql.pandas.types import to_arrow_type

    result = T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("prediction", kind),
                           T.StructField("closer", T.IntegerType())])
    label_type = to_arrow_type(kind)
    c = vectors[:, :m] if m else vectors
    shared = SparkSession.active().sparkContext.broadcast((labels, c))

    # types of the worker function are pyarrow's, and it is shipped by value: workers need not import this package
    def score(values, own, true_dist):
        import numpy as np
        import pyarrow as pa

        names, block = shared.value
        lists = values
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)[:, :block.shape[1]]
        dists = np.empty((len(x), len(block)))
        for i, center in enumerate(block):
            dists[:, i] = ((x - center) ** 2).sum(axis=1)
        best = dists.argmin(axis=1)
        place = {name: i for i, name in enumerate(names)}
        at = np.array([place.get(v, -1) for v in own.to_pylist()], np.int64)
        td = np.where(at >= 0, dists[np.arange(len(x)), np.maximum(at, 0)],
                      np.array([np.nan if v is None else v for v in true_dist.to_pylist()], np.float64))
        index = np.arange(len(block))
        own_names = own.to_pylist()
        before = np.array([sum(1 for n in names if n < v) if a < 0 and v is not None else a for v, a in zip(own_names, at)], np.int64)
        closer = (dists < td[:, None]).sum(axis=1) + ((dists == td[:, None]) & (index < before[:, None])).sum(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(dists[np.arange(len(x)), best], pa.float64()), pa.array([names[i] for i in best], label_type),
             pa.array(closer.astype(np.int32), pa.int32())], names=["dist", "prediction", "closer"])

    score.__annotations__ = {"values": pa.Array, "own": pa.Array, "true_dist": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, result)


def nearest_centroid(df: DataFrame, model: tuple[list, np.ndarray], label: str, emb: str = "embedding",
                     m: int | None = None, k: int = 5, id_col: str | None = None,
                     block_bytes: int | None = None) -> DataFrame:
    """Prediction, the rank of the true label (ties by label), and whether it is in the top ``k``.

    The model is scored in blocks of classes of at most ``block_bytes``.  With
    one block a row has all it needs; with more, the true class's distance
    comes from an equi-join on the label and one aggregate per row (``id_col``)
    combines the blocks.
    """
    labels, vectors = model
    dims = min(m or vectors.shape[1], vectors.shape[1])
    per = max(1, (block_bytes or BLOCK_BYTES) // (8 * max(1, dims)))
    kind = df.schema[label].dataType
    if len(labels) <= per:
        s = df.withColumn("_s", _block_scores(labels, vectors, kind, m)(F.col(emb), F.col(label), F.lit(None).cast("double")))
        s = s.select(*df.columns, F.col("_s.prediction").alias("prediction"), (F.col("_s.closer") + 1).alias("true_rank"))
        return s.withColumn(f"in_top{k}", F.col("true_rank") <= k)
    if id_col is None:
        raise ValueError("a model of more than one block needs id_col")
    spark = df.sparkSession
    schema = T.StructType([T.StructField(label, kind), T.StructField("_cvec", T.ArrayType(T.DoubleType()))])
    cent = spark.createDataFrame([(lab, v[:dims].tolist()) for lab, v in zip(labels, vectors)], schema)
    sq = F.aggregate(F.zip_with(as_double(emb, m), "_cvec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, z: acc + z)
    rows = df.select(id_col, label, emb).join(cent, label, "left").withColumn("_true", sq).drop("_cvec")
    parts = None
    for at in range(0, len(labels), per):
        call = _block_scores(labels[at:at + per], vectors[at:at + per], kind, m)
        part = rows.select(id_col, label, call(F.col(emb), F.col(label), F.col("_true")).alias("_s")).select(id_col, label, "_s.*")
        parts = part if parts is None else parts.unionByName(part)
    g = parts.groupBy(id_col, label).agg(F.min(F.struct("dist", "prediction"))["prediction"].alias("prediction"),
                                         (F.sum("closer") + 1).cast("int").alias("true_rank"))
    return df.join(g.drop(label), id_col, "inner").withColumn(f"in_top{k}", F.col("true_rank") <= k)


def nearest_by_prefix(df: DataFrame, model: tuple[list, np.ndarray], label: str, sizes: Sequence[int],
                      emb: str = "embedding") -> DataFrame:
    """Adds ``hits`` (array<boolean>): for each size m, whether the true class is nearest by the first m dimensions.

    One pass of one kernel: the squared differences between one size and the next
    are added to the distances so far.  Ties go to the first label; a label that
    the model lacks is never hit.  The model is one block (``BLOCK_BYTES``).
    """
    labels, vectors = model
    if vectors.nbytes > BLOCK_BYTES:
        raise ValueError("a model of more than one block: use nearest_centroid for each size")
    cuts = sorted(range(len(sizes)), key=lambda i: sizes[i])
    shared = df.sparkSession.sparkContext.broadcast((labels, vectors, [(i, sizes[i]) for i in cuts]))

    def hits(values, own):
        import numpy as np
        import pyarrow as pa

        names, centers, at = shared.value
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
        place = {name: i for i, name in enumerate(names)}
        true = np.array([place.get(v, -1) for v in own.to_pylist()], np.int64)
        dists, low = np.zeros((len(x), len(names))), 0
        found = np.zeros((len(x), len(at)), bool)
        for i, m in at:
            for c, center in enumerate(centers):
                dists[:, c] += ((x[:, low:m] - center[low:m]) ** 2).sum(axis=1)
            found[:, i], low = dists.argmin(axis=1) == true, m
        return pa.array(list(found), pa.list_(pa.bool_()))

    hits.__annotations__ = {"values": pa.Array, "own": pa.Array, "return": pa.Array}
    return df.withColumn("hits", F.arrow_udf(hits, T.ArrayType(T.BooleanType()))(F.col(emb), F.col(label)))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           num_classes: int | None = None, topk_col: str | None = "in_top5") -> DataFrame:
    """accuracy, macro F1, weighted F1, top-k accuracy, classes and samples: one row.

    Confusion counts by (label, prediction) first; the per-class algebra runs
    on that small table.  F1 is 0 for a class with zero precision and recall;
    the macro mean runs over the classes seen as label or prediction.
    """
    topk = [F.sum(F.col(topk_col).cast("long")).alias("_top")] if topk_col else []
    # labels x predictions counts: the only pass over the rows; read four times below
    conf = materialize_small(pred.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("c"), *topk))
    sup = conf.groupBy(F.col(label).alias("cls")).agg(F.sum("c").alias("support"))
    prd = conf.groupBy(F.col(prediction).alias("cls")).agg(F.sum("c").alias("predicted"))
    tp = conf.where(F.col(label) == F.col(prediction)).select(F.col(label).alias("cls"), F.col("c").alias("tp"))
    per = (sup.join(prd, "cls", "full").join(tp, "cls", "left")
           .select("cls", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("support", "predicted", "tp")]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    per = per.withColumn("f1", f1)
    if topk_col:
        top = conf.groupBy(F.col(label).alias("cls")).agg(F.sum("_top").alias("_top"))
        per = per.join(top, "cls", "left")
    aggs = [(F.sum("tp") / F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("macro_f1"),
            (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
            F.count_if(F.col("support") > 0).alias("num_classes_in_data"),
            F.sum("support").alias("num_samples")]
    if topk_col:
        aggs.append((F.sum("_top") / F.sum("support")).alias("top_5_accuracy"))
    agg = per.agg(*aggs)
    nc = F.lit(num_classes).cast("long") if num_classes is not None else F.col("num_classes_in_data")
    return agg.withColumn("num_classes", nc)


def holdout_fold(id_col: str, seed: int, folds: int = 10):
    """Deterministic fold of a row from its integer id (same on any partitioning).

    The id is reduced first, so the product fits a long for every id.
    """
    small = F.pmod(F.col(id_col), F.lit(1 << 31))
    return F.pmod(small * F.lit(2654435761) + F.lit(seed), F.lit(folds))


def residualize(df: DataFrame, centroids: DataFrame, label: str, emb: str = "embedding") -> DataFrame:
    """Adds ``residual``: embedding minus its class centroid (array<double>).

    For one attribute this is the least-squares residual on the class dummies,
    so every residual dimension is orthogonal to every dummy.
    """
    j = df.join(centroid_vectors(centroids, label), label, "inner")
    return j.withColumn("residual", F.zip_with(as_double(emb), F.col("_cvec"), lambda a, b: a - b)).drop("_cvec")


def residualize_attributes(df: DataFrame, attrs: Sequence[str], emb: str = "embedding") -> DataFrame:
    """Adds ``residual``: embedding minus its least-squares fit on the dummies of all ``attrs``.

    Full dummy regression with an intercept and one dropped (first) level per
    attribute, solved with the pseudo-inverse (empty cells allowed).  The
    fitted value depends on the row's cell only, so the data enter through one
    aggregate per cell.  The driver solves a system of the levels (never of the
    cells: normal equations and per-level sums are aggregates of the cells
    table), and each cell's fit is the sum of its levels' coefficients, joined
    back on the attributes.  With one attribute this is the class mean.
    """
    spark = df.sparkSession
    names = list(attrs)
    x = df.select(*names, F.posexplode(emb).alias("_dim", "_v"))
    cells = materialize_small(x.groupBy(*names, "_dim").agg(F.sum(F.col("_v").cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n")))
    one_dim = cells.where("_dim = 0")
    levels = [sorted(r[0] for r in one_dim.select(a).distinct().collect()) for a in names]
    place = {(a, lv): i + 1 for i, (a, lv) in enumerate((a, lv) for a, lvs in zip(names, levels) for lv in lvs[1:])}
    p = len(place) + 1
    # normal equations from counts of single levels and of pairs of levels
    dtd = np.zeros((p, p))
    dtd[0, 0] = one_dim.agg(F.sum("_n")).first()[0] or 0
    for i, a in enumerate(names):
        for r in one_dim.groupBy(a).agg(F.sum("_n").alias("_n")).collect():
            if (j := place.get((a, r[0]))):
                dtd[0, j] = dtd[j, 0] = dtd[j, j] = r["_n"]
        for b in names[i + 1:]:
            for r in one_dim.groupBy(a, b).agg(F.sum("_n").alias("_n")).collect():
                j, k = place.get((a, r[0])), place.get((b, r[1]))
                if j and k:
                    dtd[j, k] = dtd[k, j] = r["_n"]
    sums = [cells.groupBy("_dim").agg(F.sum("_s").alias("_s")).select(F.lit(0).alias("_at"), "_dim", "_s")]
    for a in names:
        index = F.create_map(*[y for lv in levels[names.index(a)][1:] for y in (F.lit(lv), F.lit(place[a, lv]))]) \
            if len(levels[names.index(a)]) > 1 else None
        if index is not None:
            by = cells.groupBy(a, "_dim").agg(F.sum("_s").alias("_s"))
            sums.append(by.select(F.try_element_at(index, F.col(a)).alias("_at"), "_dim", "_s").where("_at is not null"))
    long = sums[0]
    for part in sums[1:]:
        long = long.unionByName(part)
    table = long.toArrow().to_pydict()
    d = max(table["_dim"], default=-1) + 1
    dtx = np.zeros((p, d))
    dtx[table["_at"], table["_dim"]] = table["_s"]
    coef = np.linalg.pinv(dtd) @ dtx
    out, fit = df, None
    for i, a in enumerate(names):
        rows = [(lv, (coef[place[a, lv]] if (a, lv) in place else np.zeros(d)) + (coef[0] if i == 0 else 0.0)) for lv in levels[i]]
        schema = T.StructType([T.StructField(a, df.schema[a].dataType), T.StructField(f"_f{i}", T.ArrayType(T.DoubleType()))])
        out = out.join(spark.createDataFrame([(lv, v.tolist()) for lv, v in rows], schema), a, "inner")
        own = F.col(f"_f{i}")
        fit = own if fit is None else F.zip_with(fit, own, lambda u, w: u + w)
    residual = F.zip_with(as_double(emb), fit, lambda u, w: u - w)
    return out.select(*df.columns, residual.alias("residual"))


def gram_rows(df: DataFrame, vec: str) -> DataFrame:
    """(i, row): the rows of the Gram matrix sum_r vec_r vec_r'.

    One partial per input split, whatever cores are at hand: a split of 128 MB sends d x d
    numbers.  Each row of the matrix is summed where it meets, one array at a time.
    """

    def part(it):
        acc = None
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = np.vstack(pdf[vec].to_numpy()).astype(np.float64)
            g = x.T @ x
            acc = g if acc is None else acc + g
        if acc is not None:
            yield pd.DataFrame({"i": np.arange(acc.shape[0], dtype=np.int64), "row": list(acc)})

    def total(it):
        acc = {}
        for pdf in it:
            for i, row in zip(pdf["i"], pdf["row"]):
                acc[i] = np.array(row) if i not in acc else acc[i] + row
        if acc:
            yield pd.DataFrame({"i": list(acc), "row": list(acc.values())})

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    return df.select(vec).mapInPandas(part, schema).repartition("i").mapInPandas(total, schema)


def gram_matrix(df: DataFrame, vec: str) -> DataFrame:
    """(i, j, g) long Gram matrix."""
    return gram_rows(df, vec).select("i", F.posexplode("row").alias("j", "g")).select("i", F.col("j").cast("long").alias("j"), "g")


def gram_to_numpy(rows: DataFrame) -> np.ndarray:
    """The d x d matrix on the driver (a summary: d is the length of an embedding)."""
    table = rows.toArrow().to_pydict()
    d = len(table["i"])
    g = np.zeros((d, d))
    for i, row in zip(table["i"], table["row"]):
        g[i] = row
    return g


def svd_from_gram(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors of X from G = X'X (descending).

    Sign rule: the largest-magnitude loading of each vector is positive.
    """
    w, v = np.linalg.eigh(g)
    order = np.argsort(w)[::-1]
    w, v = np.clip(w[order], 0.0, None), v[:, order]
    idx = np.argmax(np.abs(v), axis=0)
    signs = np.sign(v[idx, np.arange(v.shape[1])])
    signs[signs == 0] = 1.0
    return np.sqrt(w), v * signs


def elbow_index(sigma: Sequence[float]) -> int:
    """Number of components before the elbow.

    The elbow is the point farthest from the chord between the first and the
    last singular value; the components before it are kept (at least one).
    """
    s = np.asarray(sigma, dtype=float)
    n = len(s)
    if n <= 2:
        return n
    x = np.arange(n, dtype=float)
    x0, y0, x1, y1 = 0.0, s[0], float(n - 1), s[-1]
    dist = np.abs((y1 - y0) * x - (x1 - x0) * s + x1 * y0 - y1 * x0) / np.hypot(y1 - y0, x1 - x0)
    return max(1, int(np.argmax(dist)))


def project(df: DataFrame, vec: str, vectors: np.ndarray, prefix: str = "INTN", scale=None) -> DataFrame:
    """Adds prefix1..k = vec . v_j (scores); ``scale`` divides component j (e.g. sigma_j for unit scores)."""
    k = vectors.shape[1]
    weights = vectors if scale is None else vectors / np.array([s if s > 0 else 1.0 for s in scale])
    shared = df.sparkSession.sparkContext.broadcast(weights)  # d x k numbers

    def scores(values):
        import numpy as np
        import pyarrow as pa

        w = shared.value
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
        return pa.array(list(x @ w), pa.list_(pa.float64()))

    scores.__annotations__ = {"values": pa.Array, "return": pa.Array}
    call = F.arrow_udf(scores, T.ArrayType(T.DoubleType()))
    out = df.withColumn("_scores", call(F.col(vec)))
    return out.select(*df.columns, *[F.col("_scores")[j].alias(f"{prefix}{j + 1}") for j in range(k)])


def nuisance_controls(spark: SparkSession, df: DataFrame, label: str, emb: str = "embedding",
                      k: int | None = None, scale: str = "score") -> tuple[DataFrame, np.ndarray, int]:
    """Attribute-orthogonal controls: residualise, QR by a tree, singular vectors, elbow (when k is None), project.

    Returns (rows with INTN1..k, singular values, k).
    """
    cents = materialize_small(class_centroids(df, label, emb))  # the QR pass and the projection read it
    res = residualize(df, cents, label, emb)
    sigma, v = singular_vectors(res, "residual")
    k = k or elbow_index(sigma)
    out = project(res, "residual", v[:, :k], scale=sigma[:k] if scale == "unit" else None)
    return out.drop("residual"), sigma, k
