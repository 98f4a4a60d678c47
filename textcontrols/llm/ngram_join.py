"""N-gram Jaccard self-join by a token-group matrix.

Documents are sets of hashed word n-grams; two link when their Jaccard
similarity reaches a threshold.  The result is the connected component of every
document.  All steps are exact:

1. Equal sets make one class; one document stands for it.
2. Tokens are ordered by their hash.  A pair that links shares a number of
   tokens among the first ones of both sets (prefix filter), so a document
   with fewer of those in common with any other document has no link and goes.
3. Of what remains, the tokens that only one set holds are put aside: they are
   in no intersection.
4. Similar sets are partitioned into groups of bounded size, by the least hash
   of the remaining tokens; the set with the fewest lone tokens joins each part
   of a group that was split.  A group keeps its token union as the columns of
   a bit matrix, one row for each set.  Links within a group come from its
   matrix; the components so far follow.
5. Groups are formed anew by component.  A set meets a group of another
   component if they share a token of their prefixes and sizes allow a link;
   the number of the set's tokens in the group's union bounds its overlap with
   every member, and only qualifying groups are opened.  The smaller component
   asks the larger, and one link to a component is enough, so a large cluster
   of near copies costs no pairs within.

Defined results: a null or empty text, or one without words, has the empty set
and is linked with nothing; fewer words than the n-gram make one token; long
texts are read whole; repeated rows are copies of each other; a null doc_id
is no candidate for the smallest id, and a component of null ids only is null;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcontrols.llm.components import components
from textcontrols.llm.work import WORD_PATTERN, arrow_schema, map_columns, require, rows_of, written

#: Tokens of the sets that one group holds at most (a larger set is a group by itself).
GROUP_TOKENS = 50_000
#: Sets that ask one copy of a group, and salts of the join back to the copies.
GROUP_QUERIES, SALTS = 500, 8
#: Tokens that a pair must share in its prefixes, in hundredths of a set.
PREFIX_SHARE = 8
#: Candidate sets (four numbers each) that are broadcast to the texts.
BROADCAST_ROWS = 500_000
#: Hashed words that a worker keeps.
MAX_WORDS = 400_000

_M = np.uint64(0xFF51AFD7ED558CCD)
#: Independent odd factors, one for each place in an n-gram.
_FACTORS = [np.uint64(xxhash.xxh64_intdigest(b"place", seed=i) | 1) for i in range(64)]


def ceil_pct(pct: int, n):
    """Ceiling of ``pct`` hundredths of ``n``, in whole numbers."""
    return (pct * n + 99) // 100


class Shingles:
    """Text -> sorted distinct 64-bit hashes of its word n-grams."""

    def __init__(self, words: int):
        self.words, self.find = words, re.compile(WORD_PATTERN).findall
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only
        words, known = self.find(raw.decode("utf-8", "surrogatepass")), self.known
        if len(known) > MAX_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        one = np.fromiter([known[w] for w in words], np.uint64, len(words))
        n = len(words)
        if not n:
            return one
        if n < self.words:
            whole = sum(int(h) * int(_FACTORS[i]) for i, h in enumerate(one)) + n
            return np.array([whole % (1 << 64)], np.uint64)
        last = n - self.words + 1
        made = one[:last] * _FACTORS[0]
        for i in range(1, self.words):
            made += one[i:i + last] * _FACTORS[i]
        made ^= made >> np.uint64(32)
        made *= _M
        made ^= made >> np.uint64(29)
        return np.unique(made)


def _sets_start(words: int, pct: int):
    def start():
        shingles = Shingles(words)

        def step(ids, keys, texts):
            for doc, key, text in zip(ids, keys, texts):
                tokens = shingles(text or "")
                n = len(tokens)
                c = xxhash.xxh3_128_intdigest(tokens.tobytes())
                least = n - ceil_pct(pct, n) + max(1, ceil_pct(PREFIX_SHARE, n)) if n else 0
                yield (doc, key, n, (c >> 64) - (1 << 63), (c & ((1 << 64) - 1)) - (1 << 63),
                       tokens[:least].view(np.int64).tolist())

        return step

    return start


def _tokens_start(words: int):
    def start():
        shingles = Shingles(words)

        def step(cids, sizes, texts):
            for cid, n, text in zip(cids, sizes, texts):
                yield cid, n, shingles(text or "").view(np.int64).tolist()

        return step

    return start


def needed(n: int, m: int, pct: int) -> int:
    """Least overlap of two sets of these sizes that reaches the threshold."""
    return -(-pct * (n + m) // (100 + pct))


class Matrix:
    """A group: its token union as columns, one bit row (a whole number) for each set."""

    def __init__(self, members: list[tuple[int, int, list[int]]], pct: int):
        self.pct = pct
        self.cids, self.sizes = [m[0] for m in members], [m[1] for m in members]
        self.union = np.unique(np.concatenate([np.array(m[2], np.int64) for m in members]))
        self.rows = [self.row(m[2]) for m in members]

    def row(self, tokens: list[int]) -> int:
        own = np.array(tokens, np.int64)
        at = np.searchsorted(self.union, own)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == own)]
        bits = np.zeros(len(self.union), np.uint8)
        bits[at] = 1
        return int.from_bytes(np.packbits(bits).tobytes(), "big")

    def linked(self, i: int, size: int, row: int, bound: int) -> bool:
        """Whether member i links with a set of this size and row; ``bound``: tokens of it in the union."""
        n = self.sizes[i]
        least = needed(n, size, self.pct)
        return bound >= least and self.pct * max(n, size) <= 100 * min(n, size) and (row & self.rows[i]).bit_count() >= least

    def links(self) -> Iterator[tuple[int, int]]:
        """One link for each member of a component within the group but its first."""
        parts: list[list[int]] = []
        counts = [r.bit_count() for r in self.rows]
        for i in sorted(range(len(self.rows)), key=lambda i: (self.sizes[i] - counts[i], self.cids[i])):
            met = []
            for part in parts:
                j = next((j for j in part if self.linked(j, self.sizes[i], self.rows[i], counts[i])), None)
                if j is not None:
                    met.append(part)
                    yield self.cids[i], self.cids[j]
            joined = [x for part in met for x in part] + [i]
            parts = [part for part in parts if part not in met] + [joined]

    def asked(self, size: int, tokens: list[int], roots: list[int]) -> Iterator[int]:
        """Members that a set from outside links with, one of each component."""
        row = self.row(tokens)
        bound, found = row.bit_count(), set()
        if bound < ceil_pct(self.pct, size):
            return
        for i, root in enumerate(roots):
            if root not in found and self.linked(i, size, row, bound):
                found.add(root)
                yield self.cids[i]


EDGES = "a long, b long"


def _open_groups(pct: int):
    """Rows (g1, g2, cid, n, tokens), sorted by group -> links within each group."""
    target = arrow_schema(EDGES)

    def out(edges):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*edges), target)], schema=target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for g1, g2, *member in rows_of(batches):
            if (g1, g2) != key:
                if len(members) > 1 and (edges := list(Matrix(members, pct).links())):
                    yield out(edges)
                key, members = (g1, g2), []
            members.append(tuple(member))
        if len(members) > 1 and (edges := list(Matrix(members, pct).links())):
            yield out(edges)

    return run


def _ask_groups(pct: int):
    """Rows (g1..g4, salt, asks, cid, n, root, tokens), members before those that ask -> links."""
    target = arrow_schema(EDGES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, roots, matrix = None, [], [], None
        for batch in batches:
            edges = []
            for g1, g2, g3, g4, salt, asks, cid, n, root, tokens in rows_of([batch]):
                if (g1, g2, g3, g4, salt) != key:
                    key, members, roots, matrix = (g1, g2, g3, g4, salt), [], [], None
                if not asks:
                    members.append((cid, n, tokens))
                    roots.append(root)
                    continue
                matrix = matrix or (Matrix(members, pct) if members else None)
                if matrix:
                    edges += [(cid, other) for other in matrix.asked(n, tokens, roots)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*edges), target)], schema=target)

    return run


def _ceil_pct(pct: int, c: Column) -> Column:
    return F.floor((F.lit(pct) * c + 99) / 100).cast("long")


def _needed(n: Column, m: Column, pct: int) -> Column:
    return F.floor((F.lit(pct) * (n + m) + (100 + pct - 1)) / (100 + pct)).cast("long")


def candidates(docs: DataFrame, reps: DataFrame, words: int, pct: int) -> DataFrame:
    """(cid, n, tokens) of the representatives that may have a link; ``tokens``: all of their tokens."""
    rows = reps.select("cid", F.explode("prefix").alias("token"))
    shared = (rows.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high"))
              .where("low <> high").select("token"))
    hits = rows.join(shared, "token").groupBy("cid").agg(F.count(F.lit(1)).alias("hits"))
    partner = _ceil_pct(pct, F.col("n"))
    least = F.greatest(F.lit(1), _ceil_pct(PREFIX_SHARE, partner))
    some = written(reps.select("cid", "n", "doc_id", "text_key").join(hits, "cid").where(F.col("hits") >= least)
                   .select("cid", "n", F.col("doc_id").alias("d"), "text_key"), "some")
    if some.count() <= BROADCAST_ROWS:  # a counted bound; beyond it the texts are shuffled on their hash
        some = F.broadcast(some)
    texts = docs.select(F.col("doc_id").alias("e"), "text", F.xxhash64("text").alias("text_key"))
    theirs = (some.join(texts, [some["text_key"] == texts["text_key"], some["d"].eqNullSafe(texts["e"])])
              .select("cid", "n", "text").dropDuplicates(["cid"]))
    return map_columns(theirs, _tokens_start(words), "cid long, n long, tokens array<long>")


def shared_tokens(sets: DataFrame, pct: int) -> DataFrame:
    """(cid, n, s, tokens): the tokens that another set holds too, rarest first; sets with too few of them go."""
    rows = sets.select("cid", F.explode("tokens").alias("token"))
    often = (rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min("cid").alias("low"), F.max("cid").alias("high"))
             .where("low <> high").select("token", "sets"))
    kept = (rows.join(often, "token").groupBy("cid")
            .agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("x")))
    return (kept.join(sets.select("cid", "n"), "cid").select("cid", "n", F.size("x").cast("long").alias("s"), F.col("x.token").alias("tokens"))
            .where(F.col("s") >= _ceil_pct(pct, F.col("n"))))


def group_links(sets: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """(the sets with their group (g1, g2), links within the groups)."""
    keyed = sets.withColumn("g1", F.array_min(F.transform("tokens", lambda t: F.xxhash64(t))))
    sizes = keyed.groupBy("g1").agg(F.sum("s").alias("held"), F.min(F.struct(F.col("s") * 1.0 / F.col("n") * -1, "cid")).alias("h"))
    sizes = sizes.select("g1", F.ceil(F.col("held") / GROUP_TOKENS).cast("int").alias("parts"), F.col("h.cid").alias("hub"))
    grouped = written(keyed.join(sizes, "g1").withColumn(
        "g2", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")), "groups")
    hubs = (grouped.where((F.col("cid") == F.col("hub")) & (F.col("parts") > 1))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> g2")
            .select("g1", F.col("part").alias("g2"), "cid", "n", "tokens"))
    rows = grouped.select("g1", "g2", "cid", "n", "tokens").union(hubs)
    links = rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_open_groups(pct), EDGES)
    return grouped, links


def cross_links(grouped: DataFrame, labels: DataFrame, pct: int) -> DataFrame:
    """Links between the components so far."""
    known = grouped.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    sizes = known.groupBy("root").agg(F.count(F.lit(1)).alias("r1"), F.sum("s").alias("held"))
    alone = F.col("r1") == 1
    known = known.join(sizes, "root").select(
        "cid", "n", "s", "root", "tokens", "r1",
        F.when(alone, F.col("g1")).otherwise(F.col("root")).alias("r2"),
        F.when(alone, F.col("g2")).otherwise(0).alias("r3"),
        F.when(alone, 0).otherwise(F.pmod(F.xxhash64("cid"), F.ceil(F.col("held") / GROUP_TOKENS))).cast("int").alias("r4"),
        F.slice("tokens", F.lit(1), (F.col("s") - _ceil_pct(pct, F.col("n")) + 1).cast("int")).alias("prefix"))
    known = written(known, "known")
    key = ["r1", "r2", "r3", "r4"]
    group = [F.col(k).alias(f"G{k[1]}") for k in key]
    index = (known.select(*group, "n", "s", F.explode("prefix").alias("token")).groupBy("token", "G1", "G2", "G3", "G4")
             .agg(F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("s").alias("s_high")))
    asking = known.select("cid", "n", "s", "r1", "r2", "r3", F.explode("prefix").alias("token"))
    before = (F.col("r1") < F.col("G1")) | ((F.col("r1") == F.col("G1")) & (
        (F.col("r2") < F.col("G2")) | ((F.col("r2") == F.col("G2")) & (F.col("r3") < F.col("G3")))))
    partner = F.greatest(F.col("n_low"), _ceil_pct(pct, F.col("n")))
    least = _needed(F.col("n"), partner, pct)
    fits = ((F.lit(100) * F.col("n") >= pct * F.col("n_low")) & (F.lit(100) * F.col("n_high") >= pct * F.col("n"))
            & (F.col("s") >= least) & (F.col("s_high") >= least))
    pairs = written(asking.join(index, "token").where(before & fits).select("cid", "G1", "G2", "G3", "G4").distinct(), "pairs")
    copies = pairs.groupBy("G1", "G2", "G3", "G4").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int").alias("copies"))
    place = ["G1", "G2", "G3", "G4"]
    asks = (pairs.join(copies, place).withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("copies")).cast("int"))
            .join(known.select("cid", "n", "root", "tokens"), "cid")
            .select(*place, "salt", F.lit(True).alias("asks"), "cid", "n", "root", "tokens"))
    members = (known.select(*group, "cid", "n", "root", "tokens").join(copies, place)
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
               .select(*place, "salt", F.lit(False).alias("asks"), "cid", "n", "root", "tokens"))
    return (members.union(asks).repartition(*place, "salt").sortWithinPartitions(*place, "salt", "asks")
            .mapInArrow(_ask_groups(pct), EDGES))


def join_components(docs: DataFrame, words: int = 5, pct: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and text_key (64-bit hash of the text) of every row."""
    require(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = written(map_columns(
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), _sets_start(words, pct),
        f"doc_id {kind}, text_key long, n long, c1 long, c2 long, prefix array<long>"), "sets")
    full = sets.where("n > 0")
    classes = full.groupBy("c1", "c2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    stand = full.join(classes.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "low"),
                      (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("low")))
    reps = written(stand.select(F.monotonically_increasing_id().alias("cid"), "c1", "c2", "n", "doc_id", "text_key", "prefix"), "reps")
    sets_left = written(candidates(docs, reps, words, pct), "tokens")
    grouped, links = group_links(written(shared_tokens(sets_left, pct), "shared"), pct)
    first = written(links, "links")
    labels = components(first)
    second = written(cross_links(grouped, labels, pct), "cross")
    labels = components(second.union(first))
    least = (labels.join(reps.select(F.col("cid").alias("v"), "doc_id"), "v").groupBy("root")
             .agg(F.min("doc_id").alias("component_id")))
    linked = (labels.join(least, "root").join(reps.select(F.col("cid").alias("v"), "c1", "c2"), "v")
              .select("c1", "c2", "component_id").dropDuplicates(["c1", "c2"]))
    shown = (classes.join(linked, ["c1", "c2"], "left").where((F.col("copies") > 1) | F.col("component_id").isNotNull())
             .select("c1", "c2", F.coalesce("component_id", "low").alias("component_id"), F.lit(True).alias("grouped"))
             .withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))))
    salted = sets.select("doc_id", "text_key", "n", "c1", "c2").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    return (salted.join(shown, ["c1", "c2", "salt"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("grouped") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    "text_key"))
