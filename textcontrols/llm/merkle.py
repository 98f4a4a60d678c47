"""Merkle manifest of a dataset, its trees kept in a van Emde Boas layout.

Every row is a leaf, the digest of its fields.  The leaves of a part ascend by
id; runs of FAN neighbours become their parent until one node, the part's
subroot, remains; the subroots, in the order of their parts, become the root
in the same way.

A tree is cut into blocks of LEVELS levels below their root (FAN ** LEVELS
leaves).  A block is one row, its nodes one binary value: the subtree is split
at half its height, the top part is stored first and the bottom parts follow
one by one, each laid out by the same rule, so that a walk from a leaf to the
root stays within few neighbouring stretches whatever the size of a cache
line.  The place of a node follows from its depth and index by arithmetic.
The roots of the blocks are the leaves of the next layer of blocks, and so on.
Proofs go down the layers: the path of a block root is joined to its block,
where each leaf adds its siblings.  A task holds one block at a time, and only
digests leave the scan.

Defined results: a null field counts as ``-``, an empty one as ``0:``; null
parts come first, null ids too; rows of the same part and id are ordered by
their digest, equal rows are leaves of their own; texts are hashed whole; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcontrols.llm.work import arrow_schema, require, written

#: Children of a node, and levels below the root of a block (4,096 leaves, 140 KB of nodes).
FAN, LEVELS = 16, 3
DIGEST = 32


# ------------------------------------------------------------------ layout
def nodes_of(levels: int) -> int:
    """Nodes of a full tree with so many levels of nodes."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (the root has 0) of a tree with so many levels of nodes."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = FAN ** (depth - top)
    return nodes_of(top) + index // below * nodes_of(levels - top) + address(levels - top, depth - top, index % below)


@lru_cache(maxsize=16)
def _places(height: int) -> tuple[list[int], ...]:
    """Byte offsets of all nodes by depth."""
    return tuple((address(height + 1, d, np.arange(FAN ** d)) * DIGEST).tolist() for d in range(height + 1))


def height_of(n: int, levels: int = LEVELS) -> int:
    """Levels below the root of a block in a layer of ``n`` nodes; ``levels`` at most."""
    height = 0
    while FAN ** height < n and height < levels:
        height += 1
    return height


def parent(run: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def grow(leaves: Sequence[bytes], height: int) -> bytes:
    """The nodes of a block in their layout; places without a node stay zero."""
    made, places, n = bytearray(nodes_of(height + 1) * DIGEST), _places(height), len(leaves)
    for at, leaf in zip(places[height], leaves):
        made[at:at + DIGEST] = leaf
    for depth in range(height - 1, -1, -1):
        below = places[depth + 1][:n]
        n = -(-n // FAN)
        for i in range(n):
            at = places[depth][i]
            made[at:at + DIGEST] = parent(bytes(made[c:c + DIGEST]) for c in below[i * FAN:(i + 1) * FAN])
    return bytes(made)


def paths(nodes: bytes, n: int, height: int, above: bytes) -> list[bytes]:
    """Of each of the ``n`` leaves of a block: its siblings level by level, then ``above``, the path of the block's root.

    A level is the place in its run, the number of siblings and the siblings' digests.
    """
    places, found = _places(height), [above]
    for depth in range(1, height + 1):
        here = -(-n // FAN ** (height - depth))
        digests = [nodes[a:a + DIGEST] for a in places[depth][:here]]
        found = [bytes((i % FAN, len(run) - 1)) + b"".join(run[:i % FAN] + run[i % FAN + 1:]) + found[i // FAN]
                 for i in range(here) for run in (digests[i - i % FAN:i - i % FAN + FAN],)]
    return found


def steps(path: bytes) -> list[tuple[bytes, bytes]]:
    """Hex text of the siblings before and after a node, level by level up to the root."""
    found, at = [], 0
    while at < len(path):
        before, n = path[at], path[at + 1]
        mid, end = at + 2 + before * DIGEST, at + 2 + n * DIGEST
        found.append((path[at + 2:mid].hex().encode(), path[mid:end].hex().encode()))
        at = end
    return found


def fold(leaf: bytes, way: Sequence[tuple[bytes, bytes]]) -> str:
    """The root that a leaf and its siblings give."""
    node = leaf.hex()
    for before, after in way:
        node = hashlib.sha256(before + node.encode() + after).hexdigest()
    return node


# ------------------------------------------------------------------ tables
def field(c: Column) -> Column:
    """A field as its parent hashes it: ``-`` if null, else byte count, colon, value."""
    said = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def _in_order(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` written in order, with ``_pid`` (its slice) and ``_local`` (its row there)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    out = written(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    return out.withColumn("_pid", F.shiftright("_at", 33)).withColumn("_local", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def _numbered(parts: DataFrame) -> DataFrame:
    """(part, n) with ``g``, the place of the part in the order of the parts."""
    placed = _in_order(parts, ["part"], "parts")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    slices = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).select("_pid", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    return placed.join(slices, "_pid").select("part", "n", (F.col("first") + F.col("_local")).alias("g"))


def _map(df: DataFrame, step: Callable[[dict], Iterable[list]], schema: str) -> DataFrame:
    """Run ``step`` on one row at a time; it gives columns of output rows."""
    target = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                for cols in step(batch.slice(at, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, target)], schema=target)

    return df.mapInArrow(run, schema)


def _blocks(nodes: DataFrame, levels: int, name: str, *payload: str) -> DataFrame:
    """(g, pos, n, node, payload) in blocks: g, block, n, m (its leaves), nodes (the layout), arrays of the payload; written."""
    size = FAN ** levels
    held = F.sort_array(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("slot"), "node", *payload)))
    rows = (nodes.groupBy("g", F.expr(f"pos div {size}").alias("block")).agg(F.max("n").alias("n"), held.alias("held"))
            .select("g", "block", "n", F.size("held").alias("m"), F.col("held.node").alias("leaves"), *[F.col(f"held.{c}").alias(c) for c in payload]))

    @F.arrow_udf("binary")
    def laid_out(n: pa.Array, leaves: pa.Array) -> pa.Array:
        return pa.array([grow(leaves[i].as_py(), height_of(n[i].as_py(), levels)) for i in range(len(n))], pa.binary())

    return written(rows.select("g", "block", "n", "m", laid_out("n", "leaves").alias("nodes"), *payload), name)


def _tops(blocks: DataFrame, levels: int) -> DataFrame:
    """Block roots: the nodes of the next layer."""
    return blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / FAN ** levels).cast("long").alias("n"),
                         F.substring("nodes", 1, DIGEST).alias("node"), (F.col("n") <= FAN ** levels).alias("whole"))


def _layers(nodes: DataFrame, most: int, levels: int, name: str, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every layer from the leaves up, and (g, node) of the roots; ``most`` is the largest n."""
    layers, roots = [_blocks(nodes, levels, name, *payload)], None
    while True:
        tops = _tops(layers[-1], levels)
        done = tops.where("whole").select("g", "node")
        roots = done if roots is None else roots.unionByName(done)
        most = -(-most // FAN ** levels)
        if most <= 1:
            return layers, roots
        layers.append(_blocks(tops.where("not whole"), levels, name))


def _paths(layers: list[DataFrame], known: DataFrame, levels: int) -> DataFrame:
    """``known`` holds (g, path, subroot) of the roots; (g, block, path, subroot) of every block of the lowest layer."""
    found = ["g", "block", "path", "subroot"]
    begin = known.select("g", F.lit(0).cast("long").alias("block"), "path", "subroot")
    here = None
    for layer in reversed(layers):
        own = layer.where(F.col("n") <= FAN ** levels).select("g").join(begin, "g").select(*found)  # one block for each g
        here = own if here is None else own.unionByName(here)
        if layer is not layers[0]:
            rows = layer.select("g", "block", "n", "m", "nodes").join(here, ["g", "block"])
            here = written(_map(rows, partial(_down, levels), "g long, block long, path binary, subroot binary"), "paths")
    return here


def _down(levels: int, row: dict) -> Iterable[list]:
    """Paths of the blocks below, whose roots are the leaves of a block."""
    first = row["block"] * FAN ** levels
    found = paths(row["nodes"], row["m"], height_of(row["n"], levels), row["path"])
    yield [[row["g"]] * row["m"], list(range(first, first + row["m"])), found, [row["subroot"]] * row["m"]]


def _over(levels: int, row: dict) -> Iterable[list]:
    """Paths of the parts, whose subroots are the leaves of a block of the tree over them."""
    (_, place, found, _), = _down(levels, row | {"subroot": None})
    height = height_of(row["n"], levels)
    yield [place, found, [row["nodes"][a:a + DIGEST] for a in _places(height)[height][:row["m"]]]]


@dataclass(frozen=True)
class Manifest:
    """Written tables of a manifest: blocks of every layer of the parts and of the tree over them, parts, root."""

    levels: int  # below the root of a block
    part_layers: list[DataFrame]
    root_layers: list[DataFrame]
    parts: DataFrame  # part, n, g, subroot
    root: DataFrame  # one row, node; none if there is no leaf


def build(leaves: DataFrame, part: str = "part", order: str = "doc_id", node: str = "leaf",
          payload: Sequence[str] = (), levels: int = LEVELS) -> Manifest:
    """Manifest of a table with one digest (binary) for each row; the payload is kept beside the leaves."""
    rows = leaves.select(F.col(part).alias("part"), F.col(order).alias("doc_id"), F.col(node).alias("node"), *payload)
    placed = _in_order(rows, ["part", "doc_id", "node"], "leaves")
    runs = placed.groupBy("_pid", "part").agg(F.count(F.lit(1)).alias("c"), F.min("_local").alias("first"))
    own = Window.partitionBy("part")  # a row for each slice that holds some of the part
    before = own.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.select("_pid", "part", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(own).alias("n")), "runs")
    parts = written(_numbered(runs.groupBy("part").agg(F.max("n").alias("n"))), "parts")
    most, n_parts = parts.agg(F.max("n"), F.count(F.lit(1))).first()
    runs = runs.join(parts.select(F.col("part").alias("p"), "g"), F.col("part").eqNullSafe(F.col("p"))).drop("p")
    runs = runs.select(F.col("_pid").alias("rp"), F.col("part").alias("p"), "first", "before", "n", "g")
    at = placed.join(runs, (F.col("_pid") == F.col("rp")) & F.col("part").eqNullSafe(F.col("p")))
    nodes = at.select("g", (F.col("_local") - F.col("first") + F.col("before")).alias("pos"), "n", "node", "doc_id", *payload)
    low, subroots = _layers(nodes, most or 0, levels, "blocks", "doc_id", *payload)
    parts = written(parts.join(subroots.withColumnRenamed("node", "subroot"), "g").select("part", "n", "g", "subroot"), "subroots")
    over = parts.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(n_parts).cast("long").alias("n"), F.col("subroot").alias("node"))
    high, root = _layers(over, n_parts, levels, "tree")
    return Manifest(levels, low, high, parts, written(root.select("node"), "root"))


def proofs(found: Manifest, changed: str) -> DataFrame:
    """One row for each leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The root is recomputed from the digest ``changed`` of the payload, where there is one, and the leaf's siblings.
    """
    levels = found.levels
    top = found.root.first()  # one digest
    root = top["node"].hex() if top else None
    known = found.root.select(F.lit(0).cast("long").alias("g"), F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))
    high = found.root_layers[0].join(_paths(found.root_layers, known, levels), ["g", "block"])
    by_part = written(_map(high.select("block", "g", "n", "m", "nodes", "path"), partial(_over, levels), "g long, path binary, subroot binary"), "paths")
    low = found.part_layers[0]
    ready = low.join(_paths(found.part_layers, by_part, levels), ["g", "block"])
    id_type = low.schema["doc_id"].dataType.elementType.simpleString()

    def step(row: dict) -> Iterable[list]:
        subroot = row["subroot"].hex()
        height, nodes = height_of(row["n"], levels), row["nodes"]
        leaves = [nodes[a:a + DIGEST] for a in _places(height)[height][:row["m"]]]
        proof, folded = [], []
        for leaf, other, path in zip(leaves, row[changed], paths(nodes, row["m"], height, row["path"])):
            way = steps(path)
            proof.append(hashlib.sha256(b"".join(map(b"".join, way))).hexdigest())
            folded.append(fold(other or leaf, way))
        n = len(leaves)
        yield [row["doc_id"], [x.hex() for x in leaves], [subroot] * n, [root] * n, proof, folded, [x == root for x in folded]]

    return _map(ready, step, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def audit(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), part: str = "source",
          order: str = "doc_id", text: str = "text", every: int = 5, levels: int = LEVELS) -> DataFrame:
    """Proofs of all rows; of those whose id's checksum ``every`` divides, the root is recomputed with the text's A-Z lower-cased."""
    require(docs, *fields, part, order, text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = [F.translate(c, upper, upper.lower()) if c == text else F.col(c) for c in fields]
    hit = F.crc32(F.col(order).cast("string").cast("binary")) % every == 0
    leaves = docs.select(F.col(part).alias("part"), F.col(order).alias("doc_id"), leaf_of(*map(F.col, fields)).alias("leaf"),
                         F.when(hit, leaf_of(*lowered)).alias("changed"))
    return proofs(build(written(leaves, "digests"), payload=("changed",), levels=levels), "changed")
