"""Near-duplicate vectors by product quantisation with inverted lists.

Equal vectors are one class, so copies cost no pairs.  A bounded sample of the
classes gives coarse centroids and, for the residuals, a codebook for each
subspace.  Every class goes to the inverted list of its nearest centroid, with
a code of a byte for each subspace and the exact error of that code.

*Sufficient probes.*  Two vectors that link are at most ``r`` apart, so one of
them can lie beyond the border between two lists only as far as their
difference reaches across it.  A vector probes each list whose border is nearer than
``margin``.  At ``margin = r`` no link can be missed.  In ``e`` effective
dimensions the difference crosses a border by about ``r / sqrt(e)``; the
default margin is BORDER_DEVIATIONS times that, at most ``r``.

Of two lists one asks the other, for each pair of lists by the parity of
their numbers; both vectors must probe the other's list.  A list is cut into
blocks; each block gets the vectors that ask its list.  Distances come from
table look-ups: the query's vector stays as it is, the listed one is its code.
A pair goes on if its distance less the code's error allows a link, so codes lose
none; exact cosines in double precision decide.  A block gives the number of
links of each class and a spanning forest of its links, never its pairs.

Defined results: a vector that is null, zero or of no finite length, or that holds a null,
NaN or infinity, links with nothing; vectors of different lengths don't link;
rows of equal vectors are linked copies; a null id is no candidate for the
smallest one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.llm.components import components
from textcontrols.llm.work import arrow_schema, require, written

#: The sample that the index is fitted on: classes (their expected number) and bytes at most; coarse lists at most.
SAMPLE, SAMPLE_BYTES, MOST_LISTS = 16_384, 32 << 20, 1024
#: Subspaces (bytes of a code), words of a codebook, rounds of k-means.
SUBSPACES, WORDS, ROUNDS = 16, 256, 8
#: Standard deviations of a linked difference across a border that a probe covers.
BORDER_DEVIATIONS = 2.5
#: Listed classes of a block, and queries that are looked up at once.
BLOCK, ASKED = 4096, 512
#: Copies of a vector that meet their class in one part.
COPIES = 50_000
#: Room for rounding of single-precision look-ups.
SLACK = 1e-3


# ------------------------------------------------------------------ model
@dataclass(frozen=True)
class Model:
    coarse: np.ndarray  # lists x dims
    words: np.ndarray  # subspaces x words x dims of a subspace
    gaps: np.ndarray  # distances of the coarse centroids
    margin: float
    reach: float  # the distance of unit vectors that just link

    @property
    def dims(self) -> int:
        return self.coarse.shape[1]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Rows as subspaces x rows x dims of a subspace, filled up with zeros."""
        s, _, w = self.words.shape
        full = np.zeros((len(x), s * w), np.float32)
        full[:, :x.shape[1]] = x
        return full.reshape(len(x), s, w).transpose(1, 0, 2)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, less the squares of the rows."""
    return (c * c).sum(1) - 2 * (x @ c.T)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(ROUNDS):
        near = _squares(x, c).argmin(1)
        order = np.argsort(near, kind="stable")
        found, at = np.unique(near[order], return_index=True)
        c[found] = np.add.reduceat(x[order], at) / np.diff([*at, len(x)])[:, None]
    return c


def fit(sample: np.ndarray, n: int, cosine: float, margin: float | None = None) -> Model:
    """Centroids and codebooks from a sample of unit vectors; ``n`` classes will be listed."""
    rng = np.random.default_rng(0)
    x = sample.astype(np.float32)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    lists = int(np.clip(2 * np.sqrt(n), 1, min(MOST_LISTS, max(1, len(x) // 8))))
    coarse = kmeans(x, lists, rng)
    left = x - coarse[_squares(x, coarse).argmin(1)]
    s = min(SUBSPACES, x.shape[1])
    wide = -(-x.shape[1] // s)
    full = np.zeros((len(x), s * wide), np.float32)
    full[:, :x.shape[1]] = left
    words = np.stack([kmeans(np.ascontiguousarray(full[:, i * wide:(i + 1) * wide]), min(WORDS, len(x)), rng) for i in range(s)])
    if margin is None:
        spread = np.linalg.eigvalsh(np.cov(x.T.astype(np.float64)).reshape(x.shape[1], -1)) if len(x) > 1 else np.ones(1)
        effective = max(1.0, spread.sum() ** 2 / max((spread ** 2).sum(), 1e-30))
        margin = reach * min(1.0, BORDER_DEVIATIONS / np.sqrt(effective))
    gaps = np.sqrt(np.maximum(0, _squares(coarse, coarse) + (coarse * coarse).sum(1)[:, None]))
    return Model(coarse, words, gaps.astype(np.float32), float(margin), reach)


def index_rows(model: Model, x: np.ndarray) -> tuple:
    """Of unit vectors: list, the lists they probe, code, error of the code, bias of the look-up."""
    x = x.astype(np.float32)
    far = _squares(x, model.coarse)
    own = far.argmin(1)
    least = far[np.arange(len(x)), own]
    probes = far - least[:, None] <= 2 * model.margin * model.gaps[own] + SLACK
    probes[np.arange(len(x)), own] = True
    left = model.spread(x - model.coarse[own])
    code = np.stack([_squares(part, words).argmin(1) for part, words in zip(left, model.words)], 1).astype(np.uint8)
    shown = np.stack([words[c] for words, c in zip(model.words, code.T)])
    error = np.sqrt(((left - shown) ** 2).sum((0, 2)))
    bias = (shown ** 2).sum((0, 2)) + 2 * (shown * model.spread(model.coarse[own])).sum((0, 2))
    return own, probes, code, error, bias


# ------------------------------------------------------------------ vectors
def unit(values: list | None) -> np.ndarray | None:
    """A vector of length 1 in double precision; None if it has no direction."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0 or np.isnan(x).any():
        return None
    x = x / most
    return x / np.sqrt(x @ x)


def _read_units():
    """embedding -> unit vector as bytes, null if it links with nothing."""
    @F.arrow_udf("binary")
    def call(values: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(values), 1024):
            found += [None if (u := unit(v)) is None else u.tobytes() for v in values.slice(at, 1024).to_pylist()]
        return pa.array(found, pa.binary())

    return call


def _vectors(data: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors filled up to ``dims``, and their own lengths."""
    own = np.array([len(d) // 8 for d in data], np.int64)
    full = np.zeros((len(data), dims))
    for i, d in enumerate(data):
        full[i, :own[i]] = np.frombuffer(d, np.float64)
    return full, own


# ------------------------------------------------------------------ search
_INDEX = "cid long, size long, vec binary, list int, probes array<int>, code binary, error float, bias float"
_ROUTED = "list int, block int, asked boolean, cid long, size long, vec binary, own int, probes array<int>, code binary, error float, bias float"
_FOUND = "cid long, links long, other long"


def _index(model: Model):
    target = arrow_schema(_INDEX)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cid, size, vec = (part.column(c) for c in ("cid", "size", "vec"))
                x, _ = _vectors(vec.to_pylist(), model.dims)
                own, probes, code, error, bias = index_rows(model, x)
                cols = [cid, size, vec, own, [np.flatnonzero(p) for p in probes], [c.tobytes() for c in code], error, bias]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c.cast(t.type)
                                                  for c, t in zip(cols, target)], schema=target)

    return run


def _route(blocks: dict[int, int]):
    """A class goes to a block of its own list as an entry, and as a query to the blocks of its list and of those it asks."""
    target = arrow_schema(_ROUTED)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    own, probes = r["list"], r["probes"]
                    rows.append((own, r["cid"] % blocks[own], False, r["cid"], r["size"], r["vec"], own, probes, r["code"], r["error"], r["bias"]))
                    asks = [p for p in probes if p == own or (own < p) == ((own + p) % 2 == 0)]
                    rows += [(p, b, True, r["cid"], r["size"], r["vec"], own, None, None, None, None) for p in asks for b in range(blocks.get(p, 0))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)

    return run


class Block:
    """The entries of a block of a list; queries stream past."""

    def __init__(self, model: Model, cosine: float, rows: list[dict]):
        self.model, self.cosine = model, cosine
        self.list = rows[0]["list"]
        self.cid = np.array([r["cid"] for r in rows], np.int64)
        self.size = np.array([r["size"] for r in rows], np.int64)
        self.x, self.own_dims = _vectors([r["vec"] for r in rows], model.dims)
        code = np.frombuffer(b"".join(r["code"] for r in rows), np.uint8).reshape(len(rows), -1)
        self.code = code.T.copy()  # by subspace
        self.bound = (model.reach + np.array([r["error"] for r in rows]) + SLACK) ** 2
        self.bias = np.array([r["bias"] for r in rows], np.float32)
        probes = [r["probes"] for r in rows]
        of = np.repeat(np.arange(len(rows)), [len(p) for p in probes])
        lists = np.concatenate(probes)
        order = np.argsort(lists, kind="stable")
        found, at = np.unique(lists[order], return_index=True)
        self.by_list = dict(zip(found.tolist(), np.split(of[order], at[1:])))
        self.links = np.zeros(len(rows), np.int64)
        self.root = np.arange(len(rows))

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def near(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) that look-ups don't exclude."""
        m = self.model
        tables = m.spread(x) @ m.words.transpose(0, 2, 1)  # subspaces x queries x words
        centre = ((x - m.coarse[self.list]) ** 2).sum(1)
        code, bias, bound = self.code[:, entries], self.bias[entries], self.bound[entries]
        dot = np.zeros((len(x), len(entries)), np.float32)
        for table, own in zip(tables, code):
            dot += table[:, own]
        q, e = np.nonzero(centre[:, None] + bias - 2 * dot <= bound)
        return q, entries[e]

    def ask(self, own: int, cid: np.ndarray, size: np.ndarray, vec: list[bytes]) -> Iterator[tuple]:
        """Queries of the list ``own``; yields (cid, links, a linked class or null)."""
        same = own == self.list
        entries = np.arange(len(self.cid)) if same else self.by_list.get(own, np.zeros(0, np.int64))
        if not len(entries):
            return
        x, dims = _vectors(vec, self.model.dims)
        q, e = self.near(x.astype(np.float32), entries)
        keep = (cid[q] != self.cid[e]) & (dims[q] == self.own_dims[e])
        q, e = q[keep], e[keep]
        step = max(1, (1 << 22) // self.model.dims)
        exact = np.concatenate([(x[q[i:i + step]] * self.x[e[i:i + step]]).sum(1) for i in range(0, len(q), step)] or [np.zeros(0)])
        q, e = q[exact >= self.cosine], e[exact >= self.cosine]
        if not same:
            np.add.at(self.links, e, size[q])
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        for i, linked in zip(q[starts].tolist(), np.split(e, starts[1:])) if len(q) else ():
            first = self.top(int(linked[0]))
            yield int(cid[i]), int(self.size[linked].sum()), int(self.cid[first])
            for other in linked[1:].tolist():
                other = self.top(other)
                if other != first:
                    self.root[other] = first
                    yield int(self.cid[other]), 0, int(self.cid[first])

    def counts(self) -> Iterator[tuple]:
        for i in np.flatnonzero(self.links).tolist():
            yield int(self.cid[i]), int(self.links[i]), None


def _search(model: Model, cosine: float):
    """Rows sorted by list, block, entries first, then queries by their own list."""
    target = arrow_schema(_FOUND)
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)

    def run(batches):
        key, rows, block = None, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part, out = batch.slice(at, ASKED).to_pylist(), []
                i = 0
                while i < len(part):
                    r = part[i]
                    if (r["list"], r["block"]) != key:
                        out += block.counts() if block else ()
                        key, rows, block = (r["list"], r["block"]), [], None
                    if not r["asked"]:
                        rows.append(r)
                        i += 1
                        continue
                    end = i
                    while end < len(part) and part[end]["asked"] and (part[end]["list"], part[end]["block"], part[end]["own"]) == (*key, r["own"]):
                        end += 1
                    if block is None and rows:
                        block = Block(model, cosine, rows)
                    if block:
                        asked = part[i:end]
                        out += block.ask(r["own"], np.array([q["cid"] for q in asked], np.int64), np.array([q["size"] for q in asked], np.int64),
                                         [q["vec"] for q in asked])
                    i = end
                if out:
                    yield made(out)
        if block and (out := list(block.counts())):
            yield made(out)

    return run


def class_links(classes: DataFrame, cosine: float, margin: float | None = None) -> DataFrame:
    """(cid, links, other) of classes (cid, size, vec): parts of the numbers of links, and edges of spanning forests."""
    n = classes.count()
    spark = classes.sparkSession
    if not n:
        return spark.createDataFrame([], _FOUND)
    widest = classes.agg(F.max(F.octet_length("vec"))).first()[0]
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES / widest) / n)
    sample = classes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("vec").collect()
    data = sorted(r["vec"] for r in sample) or [classes.select("vec").first()["vec"]]
    x, _ = _vectors(data, widest // 8)
    model = fit(x, n, cosine, margin)
    index = written(classes.mapInArrow(_index(model), _INDEX), "index")
    blocks = {r["list"]: -(-r["count"] // BLOCK) for r in index.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    routed = index.mapInArrow(_route(blocks), _ROUTED)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = routed.repartition(parts, "list", "block").sortWithinPartitions("list", "block", "asked", "own")
    return written(placed.mapInArrow(_search(model, cosine), _FOUND), "links")


def dedup(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    require(rows, vec_id, embedding)
    read = written(rows.select(F.col(vec_id).alias("vec_id"), _read_units()(F.col(embedding)).alias("vec"),
                               F.xxhash64(embedding).alias("h1"), F.xxhash64(F.lit(1), F.col(embedding)).alias("h2")), "vectors")
    same = ["h1", "h2"]
    classes = read.where("vec is not null").groupBy(*same).agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"), F.max("vec").alias("vec"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = class_links(classes.select("cid", "size", "vec"), cosine, margin)
    roots = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = (classes.select("cid", *same, "size", "least").join(roots.withColumnRenamed("v", "cid"), "cid", "left").join(links, "cid", "left")
              .withColumn("root", F.coalesce("root", "cid")))
    linked = written(linked, "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.join(least, "root").select(*same, "size", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # the rows of a class of many copies meet it in parts; there are at most rows / COPIES such classes
    parts = F.ceil(F.col("size") / COPIES).cast("int")
    hot = F.broadcast(known.where(parts > 1).select(*same, parts.alias("parts")))
    keyed = read.select("vec_id", *same, F.col("vec").isNotNull().alias("valid")).join(hot, same, "left")
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    spread = known.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    full = keyed.join(spread.drop("size").withColumn("valid", F.lit(True)), [*same, "part", "valid"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.col("vec_id").eqNullSafe(component).alias("kept"))
