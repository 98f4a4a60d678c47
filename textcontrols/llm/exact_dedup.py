"""Exact dedup by composable polynomial fingerprints.

A text, with A-Z lower-cased, is hashed chunk by chunk as a polynomial over its
bytes, modulo two primes.  Chunk hashes combine by shifting the left one by the
length of the right one, so chunks can be hashed in any order or place and a
huge text never needs more than one chunk of work space.  Rows are grouped on
(length, fingerprint); within a group every text is compared, chunk by chunk in
sorted streams, with the text of the group's last row.  A row that differs
(equal fingerprints by chance) goes on under its SHA-256 digest.

The comparison of a large group is spread over slots, each with a copy of the
one text to compare with, and the join of a large group is salted.

Defined results: a null text counts as empty, so null and empty texts are
equal; of equal texts the row with the largest doc_id stays (null the
smallest); of repeated rows with that doc_id one stays; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.llm.work import arrow_schema, map_columns, require, text_udf, written

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes of a chunk, and of a row of the inner product.
CHUNK, ROW = 1 << 20, 256
#: Rows of a group that are compared in one slot, and salts of the group join.
SLOT_ROWS, SALTS = 100, 8

_KEY = ["n_bytes", "h1", "h2"]


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    found = np.ones(n, np.uint64)
    for i in range(n - 2, -1, -1):
        found[i] = int(found[i + 1]) * base % prime
    return found


_INNER = [_powers(b, p, ROW) for b, p in zip(BASES, PRIMES)]
_OUTER = [_powers(pow(b, ROW, p), p, CHUNK // ROW) for b, p in zip(BASES, PRIMES)]


def chunk_print(data: bytes) -> tuple[int, int]:
    """Polynomial hashes of one chunk (at most CHUNK bytes)."""
    rows = -(-len(data) // ROW)
    if not rows:
        return 0, 0
    grid = np.zeros(rows * ROW, np.uint64)
    grid[rows * ROW - len(data):] = np.frombuffer(data, np.uint8)
    grid = grid.reshape(rows, ROW)
    out = []
    for inner, outer, prime in zip(_INNER, _OUTER, PRIMES):
        p = np.uint64(prime)
        line = grid @ inner % p
        out.append(int((line * outer[-rows:] % p).sum() % p))
    return out[0], out[1]


def combined(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """Hashes of two neighbouring chunks together: the left shifted by the length of the right."""
    return tuple((a * pow(b, right_bytes, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES))


def normal(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only


def fingerprint(data: bytes) -> tuple[int, int]:
    whole = (0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at:at + CHUNK]
        whole = combined(whole, chunk_print(part), len(part))
    return whole


def _start():
    def step(text: str) -> tuple:
        data = normal(text)
        return (len(data), *fingerprint(data), hashlib.sha256(data).hexdigest())

    return step


def prints(text):
    """Struct of length, fingerprint and digest of a text column."""
    return text_udf(_start, "n_bytes long, h1 long, h2 long, text_sha256 string")(text)


def _chunks():
    def step(n_bytes, h1, h2, doc_id, is_first, slots, slot, texts):
        for n, a, b, d, first, all_slots, own, text in zip(n_bytes, h1, h2, doc_id, is_first, slots, slot, texts):
            data = normal(text or "")
            for s in range(all_slots) if first else (own,):
                for k, at in enumerate(range(0, max(1, len(data)), CHUNK)):
                    yield n, a, b, s, k, not first, d, data[at:at + CHUNK]

    return step


def _compare(schema: str):
    """Rows sorted by key, slot, chunk and with the group's text first; yields the ids of chunks that differ from it."""
    target = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text = None, b""
        for batch in batches:
            found = []
            cols = [c.to_pylist() for c in batch.columns]
            for n, a, b, slot, chunk, _, doc, data in zip(*cols):
                if (n, a, b, slot, chunk) != key:
                    key, text = (n, a, b, slot, chunk), data
                elif data != text:
                    found.append((n, a, b, doc))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), target)], schema=target)

    return run


def differing(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(n_bytes, h1, h2, doc_id) of the rows whose text isn't the one of their fingerprint group's last row."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    salted = rows.select("doc_id", "text", prints(F.col("text")).alias("r")).select("doc_id", "text", "r.*").drop("text_sha256")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    slots = F.ceil(F.col("group_rows") / SLOT_ROWS).cast("int")
    members = salted.join(spread, [*_KEY, "salt"]).select(
        *_KEY, "doc_id", F.col("doc_id").eqNullSafe(F.col("last_id")).alias("is_first"), slots.alias("slots"),
        F.pmod(F.xxhash64("doc_id", F.lit(2)), slots).cast("int").alias("slot"), "text")
    chunks = map_columns(members, _chunks, "n_bytes long, h1 long, h2 long, slot int, chunk int, "
                                           f"is_member boolean, doc_id {id_type}, data binary")
    place = [*_KEY, "slot", "chunk"]
    schema = f"n_bytes long, h1 long, h2 long, doc_id {id_type}"
    return (chunks.repartition(*place).sortWithinPartitions(*place, "is_member")
            .mapInArrow(_compare(schema), schema).distinct())


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    require(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = written(rows.select("doc_id", prints(F.col("text")).alias("r"))
                   .select("doc_id", "r.*", F.monotonically_increasing_id().alias("row")), "prints")
    groups = (made.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("group_rows"), F.max("doc_id").alias("last_id"))
              .where("group_rows > 1"))
    odd = written(differing(rows, groups), "differ").withColumn("odd", F.lit(True))
    same_id = made["doc_id"].eqNullSafe(odd["doc_id"])
    known = made.join(odd, same_id & (made["n_bytes"] == odd["n_bytes"]) & (made["h1"] == odd["h1"]) & (made["h2"] == odd["h2"]), "left")
    known = known.select(made["doc_id"], *[made[k] for k in _KEY], made["text_sha256"], made["row"],
                         F.when(F.col("odd"), made["text_sha256"]).otherwise(F.lit("")).alias("variant"))
    classes = (known.groupBy(*_KEY, "variant")
               .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "row")).alias("last")).where("size > 1")
               .withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))))
    salted = known.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    full = salted.join(classes, [*_KEY, "variant", "salt"], "left")
    return full.select(
        "doc_id", F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256")
