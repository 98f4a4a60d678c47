"""Audit of how filters interact, by a stream that retracts.

Each text fails some of the filters A to E; what a filter removes depends on
those before it.  The files of a table are read as available-now micro-batches
of a stream.  A to D are of the text alone and are computed at the scan; only
a digest of the text goes on.  E (an equal text under a smaller id) is of the
whole table: keyed state holds, for each text, the smallest id so far and what
its rows were counted as.  When a smaller id arrives, the state takes the
earlier rows' count back from the counters of their parts and counts them again as
failing E.  So the counters are right after each micro-batch, and no text is
compared twice.

The state is kept in buckets of about BUCKET_TEXTS texts, by digest; their number follows
the rows of the table.  Rows of a batch are combined by text before they are
shuffled, so a text that a third of the rows share is one row for each Arrow batch.
The counters of a part are signed sums in an append-only sink, at most one row
for each combination; the tables over all orders come from their sums.

Defined results: a null text counts as empty, a null part as the empty string;
a row without an id never fails E and makes none fail it; rows of the smallest
id that repeat it don't fail; a document is good or toxic if any row of the
labels says 1; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textcontrols.llm.work import arrow_schema, require, written
from textcontrols.session import checkpoint_dir

#: The filters' letters, in the order of their bits.
LETTERS = "ABCDE"
SEEN = 16  # the bit of E
#: Micro-batches of a table, and distinct texts of a bucket of the state.
BATCHES, BUCKET_TEXTS = 4, 128
#: The state is on disk and in the checkpoint, not on the heap; each partition's store holds no disk in reserve (4 MB or more).
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}

#: count: part, label (1: good, 2: toxic), rows.
_COUNTS = "array<struct<part: string, label: int, n: long>>"
_DELTA = "part string, mask int, label int, n long"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
             100 * upper > 5 * F.length(t), t.rlike(r"[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def _combine(id_type: str):
    """Rows of an Arrow batch -> one row for each text: its smallest id, what holds it, and the other rows."""
    target = arrow_schema(f"bucket long, key binary, mask int, id {id_type}, held {_COUNTS}, others {_COUNTS}")

    def run(batches):
        for batch in batches:
            found: dict[tuple, list] = {}
            for bucket, key, mask, doc, part, label in zip(*(c.to_pylist() for c in batch.columns)):
                own = found.setdefault((key, doc is None), [bucket, mask, doc, {}, {}])
                if doc is not None and doc < own[2]:
                    for k, n in own[3].items():
                        own[4][k] = own[4].get(k, 0) + n
                    own[2], own[3] = doc, {}
                into = own[3] if doc == own[2] else own[4]
                into[part, label] = into.get((part, label), 0) + 1
            rows = [(b, key, mask, doc, _listed(held), _listed(others)) for (key, _), (b, mask, doc, held, others) in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)

    return run


def _listed(counts: dict) -> list[dict]:
    return [{"part": p, "label": k, "n": n} for (p, k), n in counts.items()]


class Counters:
    """Signed changes of the counters (part, mask, label)."""

    def __init__(self):
        self.n: dict[tuple, int] = {}

    def add(self, counts, mask: int, sign: int = 1) -> None:
        for part, label, n in counts:
            self.n[part, mask, label] = self.n.get((part, mask, label), 0) + sign * n

    def rows(self) -> list[tuple]:
        return [(*k, n) for k, n in self.n.items() if n]


def arrive(state: dict, key: str, mask: int, doc, held: list, others: list, change: Counters) -> None:
    """A text's rows arrive: ``held`` of the id ``doc``, ``others`` of larger ids; lists of (part, label, n)."""
    change.add(others, mask | SEEN)
    if doc is None:
        change.add(held, mask)
        return
    known = state.get(key)
    if known is None or doc < known[0]:
        if known is not None:  # what was the first one isn't any more
            change.add(known[1], mask, -1)
            change.add(known[1], mask | SEEN)
        state[key] = [doc, held]
        change.add(held, mask)
    elif doc == known[0]:
        known[1] = known[1] + held
        change.add(held, mask)
    else:
        change.add(held, mask | SEEN)


def _bucket(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = json.loads(state.get[0]) if state.exists else {}
    change = Counters()
    listed = lambda counts: [(c["part"], int(c["label"]), int(c["n"])) for c in counts]
    for frame in frames:
        for text, mask, doc, held, others in zip(frame["key"], frame["mask"], frame["id"], frame["held"], frame["others"]):
            if doc is not None and not isinstance(doc, str):
                doc = None if pd.isna(doc) else int(doc)
            arrive(known, bytes(text).hex(), int(mask), doc, listed(held), listed(others), change)
    state.update((json.dumps(known),))
    yield pd.DataFrame(change.rows(), columns=["part", "mask", "label", "n"])


def deltas(stream: DataFrame, labels: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Signed changes of the counters (part, mask, label, n) as a stream."""
    require(stream, doc_id, text, part)
    id_type = stream.schema[doc_id].dataType.simpleString()
    if id_type != "string":
        id_type = "bigint"
    key = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = stream.select(F.unhex(key).alias("key"), text_mask(F.col(text)).alias("mask"), F.col(doc_id).cast(id_type).alias("id"),
                         F.coalesce(F.col(part), F.lit("")).alias("part"))
    said = labels.groupBy(F.col("doc_id").cast(id_type).alias("said")).agg(
        (F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")) + 2 * F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int"))).alias("label"))
    known = rows.join(written(said.where("label > 0"), "labels"), F.col("id") == F.col("said"), "left")
    placed = known.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "mask", "id", "part",
                          F.coalesce(F.col("label"), F.lit(0)).alias("label"))
    combined = placed.mapInArrow(_combine(id_type), f"bucket long, key binary, mask int, id {id_type}, held {_COUNTS}, others {_COUNTS}")
    # JSON of the bucket's texts: digest -> [smallest id, [[part, label, rows], ...]]
    return combined.groupBy("bucket").applyInPandasWithState(_bucket, _DELTA, "texts string", "append", GroupStateTimeout.NoTimeout)


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text",
             part: str = "source", work: str | None = None, buckets: int | None = None) -> DataFrame:
    """(part, mask, label, n) of a Parquet table, streamed in about ``batches`` micro-batches.

    ``work`` names a folder for the stream's checkpoint and counters: a run
    that was broken off, or for which files have come since, goes on from there
    (with the same ``buckets``; by default they follow the rows).
    """
    table = spark.read.parquet(path)
    buckets = buckets or max(1, -(-table.count() // BUCKET_TEXTS))
    work = work or f"{checkpoint_dir(spark).rstrip('/')}/llm-audit-{uuid.uuid4().hex}"
    alone = path.rstrip("/")
    alone = f"{alone[:-1]}[{alone[-1]}]"  # a pattern of just this name: the path may be a file or a folder
    stream = (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(table.inputFiles()) // batches))).parquet(alone))
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = (deltas(stream, labels, buckets, doc_id, text, part).writeStream.format("parquet").option("path", f"{work}/counters")
                 .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    changes = spark.read.schema(_DELTA).parquet(f"{work}/counters")
    return changes.groupBy("part", "mask", "label").agg(F.sum("n").alias("n")).where("n <> 0")


def over_orders(counted: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what the step's filter removes, and what it would have."""
    masks = range(1 << len(LETTERS))

    def total(mask: int, bit: int) -> Column:
        own = F.when((F.col("mask") == mask) & (F.lit(not bit) | (F.col("label").bitwiseAND(F.lit(bit)) != 0)), F.col("n"))
        return F.coalesce(F.sum(own), F.lit(0))

    cells = F.array(*[F.struct(F.lit(m).alias("mask"), total(m, 0).alias("n"), total(m, 1).alias("good"), total(m, 2).alias("toxic")) for m in masks])
    parts = counted.groupBy("part").agg(cells.alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = (parts.withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS))))))
    bits = {c: 1 << i for i, c in enumerate(LETTERS)}
    earlier = sum((F.when(F.instr(F.col("filter_order"), c) < F.col("step"), F.lit(b)).otherwise(0) for c, b in bits.items()), F.lit(0))
    own = F.element_at(F.create_map(*[F.lit(x) for cb in bits.items() for x in cb]), F.substr("filter_order", F.col("step"), F.lit(1)))
    placed = steps.withColumn("own", own).withColumn("earlier", earlier)

    def summed(cond, value=lambda x: x["n"]) -> Column:
        """Over the cells for which ``cond(fails its own, fails an earlier one, cell)``."""
        here = F.filter("cells", lambda x: cond(x["mask"].bitwiseAND(F.col("own")) != 0, x["mask"].bitwiseAND(F.col("earlier")) != 0, x))
        return F.aggregate(here, F.lit(0).cast("long"), lambda a, x: a + value(x)).cast("long")

    removed = lambda fails, before, x: fails & ~before
    n_orders = len(list(permutations(LETTERS)))
    return placed.select(
        "part", "filter_order", "step", summed(lambda f, b, x: ~f & ~b).alias("kept"), summed(removed).alias("removed"),
        summed(lambda f, b, x: f & b).alias("redundant"), summed(lambda f, b, x: x["mask"] == F.col("own")).alias("unique_fails"),
        summed(removed, lambda x: x["good"]).alias("good_lost"), summed(removed, lambda x: x["toxic"]).alias("toxic_lost"),
        summed(lambda f, b, x: f, lambda x: (x["n"] * F.lit(n_orders) / F.bit_count(x["mask"])).cast("long")).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, **names) -> DataFrame:
    """The audit of a table of texts; see ``counters`` for the names of columns."""
    return over_orders(counters(spark, path, labels, **names))
