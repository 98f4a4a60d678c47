"""Quality classifier: regularised quadratic discriminant over text statistics.

Statistics of each whole text are transformed towards normality.  Spark sums
their first and second moments for each class over every labelled row; the
driver gets one row of sums for each class, whatever the size of the input.
Class covariances are shrunk towards the pooled one and towards its diagonal.
A score is the logistic of the difference of the two log densities, with the
Mahalanobis distances solved through Cholesky factors that are computed once
and shipped with the function.

Defined results: a null or empty text has the statistics of the empty text and
gets a score; a document without a label, or with a null label, takes no part
in the fit; several labels for one doc_id count each; a class without rows
leaves the other's prior to decide (score 1 or 0; 0.5 if there is no label at
all); an empty table gives an empty table; other columns are passed by.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textcontrols.llm.work import WORD_PATTERN, require, sliced, written

#: Transformed statistics, in the order of the vectors.
STATISTICS = (
    "log_words", "mean_word_length", "log_sd_word_length", "log_symbols", "log_exclamations", "upper_share",
    "log_digits", "log_punctuation", "distinct_words", "repeated_lines", "log_compression", "repeated_pairs",
)
#: Share of the pooled covariance in a class covariance, and of the diagonal in the result.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
THRESHOLD = 0.3
#: Log-density differences are divided by this: the statistics are not quite normal, and the tails too sure.
TEMPER = 2.0


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    words = re.findall(WORD_PATTERN, text)
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = byte[65:91].sum(), byte[97:123].sum()
    symbols = byte[[ord(c) for c in "#*$%&|<>"]].sum()
    marks = byte[[ord(c) for c in ".,;:?()-'\""]].sum()
    pairs = n - 1 - len(set(zip(words, words[1:])))
    per_word = lambda count: float(np.log((count + 0.05) / n + 0.01))
    return [
        float(np.log1p(n)), float(lengths.mean()), float(np.log(lengths.std() + 0.5)), per_word(symbols), per_word(byte[33]),
        float(np.arcsin(np.sqrt((upper + 0.5) / (upper + lower + 1.0)))), per_word(byte[48:58].sum()), per_word(marks),
        float(np.log((len(set(words)) + 1.0) / (n + 1.0))), float(np.arcsin(np.sqrt(1 - len(set(lines)) / max(1, len(lines))))),
        float(np.log(len(zlib.compress(raw, 1)) / len(raw))), float(np.arcsin(np.sqrt(max(0, pairs) / n))),
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t or "") for t in sliced(texts)], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log-density constants (class 0, class 1)."""

    means: np.ndarray | None
    factors: np.ndarray | None
    constants: np.ndarray | None
    only: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.only)
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
                   for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1.0 / (1.0 + np.exp(np.clip((density[0] - density[1]) / TEMPER, -700, 700)))


def discriminant(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> Discriminant:
    """From rows, sums (2, d) and sums of products (2, d, d) of each class."""
    d = total.shape[1]
    if not n.all():
        return Discriminant(None, None, None, 0.5 if not n.any() else float(n[1] > 0))
    means = total / n[:, None]
    scatter = squares - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / max(1.0, n.sum() - 2)
    floor = 1e-6 + 1e-3 * np.diag(pooled)
    factors, constants = [], []
    for k in (0, 1):
        own = scatter[k] / max(1.0, n[k] - 1)
        share = max(TO_POOLED, d / (d + n[k]))  # the fewer rows, the more of the pooled covariance
        cov = (1 - share) * own + share * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + np.diag(floor)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[k] / n.sum()) * TEMPER - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def fit(vectors: DataFrame, target: str, values: str = "stats") -> Discriminant:
    """Fit on every row with a label 0 or 1: one aggregation, two rows of sums to the driver."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    rows = (vectors.select(F.col(target).cast("int").alias("y"), F.col(values).alias("x")).where("y in (0, 1)")
            .groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)],
                              *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect())
    n, total, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        k = r["y"]
        n[k] = r["n"]
        total[k] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            squares[k, i, j] = squares[k, j, i] = r[f"p{i}_{j}"]
    return discriminant(n, total, squares)


def score_of(model: Discriminant):
    """Column function: vector of statistics -> score."""

    @F.arrow_udf(DoubleType())
    def call(values: pa.Array) -> pa.Array:
        x = np.array(values.to_pylist(), np.float64).reshape(-1, len(STATISTICS))
        return pa.array(model.scores(x), pa.float64())

    return call


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from: remainder 0 of the checksum of the id as text (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, stats) of every row, written once: the fit and the scores read it, the texts are read once."""
    require(docs, doc_id, text)
    made = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                       statistics_of(F.col(text)).alias("stats"))
    return written(made, "quality")


def fit_labels(made: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on the labelled rows outside the held-out fold; the join moves ids and vectors, no text."""
    known = labels.select(F.col("doc_id"), F.col(label).alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(made.join(known, "doc_id"), "y")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    made = vectors(docs)
    model = fit_labels(made, labels)
    scored = made.select("doc_id", "held_out", score_of(model)(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all its columns) with a score of THRESHOLD or more."""
    require(docs, "doc_id", "text")
    model = fit_labels(vectors(docs), labels)
    return docs.where(score_of(model)(statistics_of(F.col("text"))) >= THRESHOLD)
