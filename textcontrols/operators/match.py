"""Ordered matching of texts to a catalog lookup, and paired control differences.

Semantics (a dictionary lookup followed by a linear scan):

1. the lookup maps a normalised text to a vector; a key seen twice keeps its
   first position and its last vector;
2. a query whose normalised text equals a key takes that key;
3. otherwise the key with the smallest position such that the key contains
   the query or the query contains the key;
4. otherwise no match.

Plan: one scan normalises the texts, gives two 64-bit hashes of each and looks
for anchors.  Whatever string is contained holds its inner words whole, so
three of them (one, or its first characters, where there are fewer) are
somewhere in its container.  Of a key's windows the one that the fewest keys
share is its anchor; a Bloom filter of all keys' anchors goes to the scan, and
only a text that may have a candidate crosses a shuffle, once for all its
copies; of the others the hashes do.  Exact hits are an equi-join on hashes,
candidates one on anchors, of which frequent ones are salted by count.  Pairs
are ids and positions until texts and keys are compared.  No join is a nested
loop and no text goes to a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.functions.text import normalize_text, word_count
from textcontrols.operators._util import materialize_small, stored, text_key
from textcontrols.session import send_package

#: Kinds of anchors: three inner words, one inner word, or the first characters (1 to HEAD).
THREE_WORDS, ONE_WORD, HEAD = 100, 50, 6
#: Bits of the filter for each anchor, its least and most bits (2 ** 28: 32 MB), bits of a chunk.
BITS, LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 1 << 16, 1 << 28, 1 << 16
#: Rows and bytes of text that a task takes apart at once, and windows that it holds: each takes some hundred bytes.
SLICE_ROWS, SLICE_BYTES, WINDOWS = 1024, 1 << 20, 1 << 16
#: Texts of one anchor that meet in one task; keys are broadcast up to this many bytes, counted.
HOT_TEXTS, KEY_BYTES = 5_000, 32 << 20


def build_lookup(catalog: DataFrame, text_col: str, pos_col: str, value_cols: Sequence[str] | str,
                 materialize: bool = True) -> DataFrame:
    """Lookup (key, pos, vec): normalised text -> vector of doubles.

    ``value_cols``: the columns of the vector, or one array column.  A key
    repeated in the catalog keeps its first position and the vector of its last
    occurrence (dictionary-update rule).  Several joins read the lookup, so it
    is written once (``materialize``).
    """
    if isinstance(value_cols, str):
        vec = F.transform(value_cols, lambda x: x.cast("double"))
    else:
        vec = F.array(*[F.col(c).cast("double") for c in value_cols])
    lk = (
        catalog.select(normalize_text(text_col).alias("key"), F.col(pos_col).cast("long").alias("pos"),
                       vec.alias("vec"))
        .groupBy("key")
        .agg(F.min("pos").alias("pos"), F.max_by("vec", "pos").alias("vec"))
    )
    return materialize_small(lk) if materialize else lk


def raw_key(c, prefix: str = "_r") -> list:
    """Two 64-bit hashes of the raw text (cheap; computed on every row)."""
    return [h.alias(f"{prefix}{i}") for i, h in enumerate(text_key(c), 1)]


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    """64-bit finaliser of hashes of a kind."""
    x = x + np.uint64((kind + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of SLICE_ROWS rows and SLICE_BYTES of the column's text at most; a longer text is a part by itself."""
    upto = np.cumsum(pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        end = min(max(end, at + 1), at + SLICE_ROWS)
        yield batch.slice(at, end - at)
        at = end


class Pieces:
    """Words and characters of a batch of texts as flat arrays, and hashes of their windows."""

    def __init__(self, texts: pa.Array):
        import pandas as pd

        self.texts = texts
        words = pc.ascii_split_whitespace(texts)
        self.n_words = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        known = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
        self.words = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
        self.n_chars = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self._chars: np.ndarray | None = None

    @property
    def chars(self) -> np.ndarray:
        if self._chars is None:
            joined = "".join(t or "" for t in self.texts.to_pylist())
            self._chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._chars

    def windows(self, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place in the row, hash) of all windows of a kind, in their order, from WINDOWS places at a time."""
        flat, lengths, wide = (self.words, self.n_words, 3 if kind == THREE_WORDS else 1) if kind >= ONE_WORD else (self.chars, self.n_chars, kind)
        ends = np.cumsum(lengths)
        for at in range(0, len(flat), WINDOWS):
            upto = min(at + WINDOWS, len(flat))
            first, last = np.searchsorted(ends, (at, upto - 1), side="right")
            rows = np.arange(first, last + 1)
            row = np.repeat(rows, np.minimum(ends[rows], upto) - np.maximum(ends[rows] - lengths[rows], at))
            spot = np.arange(at, upto)
            place = spot - (ends - lengths)[row]
            held = place + wide <= lengths[row]
            row, place, spot = row[held], place[held], spot[held]
            x = np.zeros(len(spot), np.uint64)
            for j in range(wide):
                x = x * np.uint64(0x100000001B3) + flat[spot + j]
            yield row, place, _mixed(x, kind).view(np.int64)

    def kinds(self) -> np.ndarray:
        """The kind of anchor of each text as a contained one; 0 for the empty text."""
        return np.where(self.n_words >= 5, THREE_WORDS, np.where(self.n_words >= 3, ONE_WORD, np.minimum(self.n_chars, HEAD)))

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, hash) of the windows that any container of a text holds whole: of its inner words, else its first characters."""
        kinds, found = self.kinds(), []
        for kind in np.unique(kinds[kinds > 0]).tolist():
            for row, place, h in self.windows(kind):
                last = self.n_words[row] - (4 if kind == THREE_WORDS else 2)
                inner = (place >= 1) & (place <= last) if kind >= ONE_WORD else place == 0
                keep = inner & (kinds[row] == kind)
                found.append((row[keep], place[keep], h[keep]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _key_windows(every: bool):
    """Keys (pos, key) -> (pos, g, kind): windows that a container holds whole, or ``every`` window of each kind."""
    def run(batches):
        for whole in batches:
            for batch in _slices(whole, "key"):
                texts = Pieces(batch.column("key"))
                pos = batch.column("pos").to_numpy(zero_copy_only=False)
                for kind in ([*range(1, HEAD + 1), ONE_WORD, THREE_WORDS] if every else (0,)):
                    for row, _, g in texts.windows(kind) if every else [texts.own()]:
                        of = np.full(len(g), kind) if every else texts.kinds()[row]
                        yield pa.RecordBatch.from_arrays([pa.array(pos[row], pa.int64()), pa.array(g, pa.int64()), pa.array(of, pa.int32())], names=["pos", "g", "kind"])

    return run


def bloom_bits(hashes: DataFrame) -> np.ndarray | None:
    """Bloom filter (two probes) of a column ``g`` of 64-bit hashes as bytes; None if there are none."""
    n = hashes.count()
    if not n:
        return None
    m = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * n - 1).bit_length()))
    at = hashes.select(F.explode(F.array(F.col("g").bitwiseAND(m - 1), F.shiftrightunsigned("g", 32).bitwiseAND(m - 1))).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / CHUNK_BITS).alias("chunk"), F.floor(F.pmod("p", F.lit(CHUNK_BITS)) / 64).cast("int").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))

    @F.arrow_udf("binary")
    def packed(w: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for places, bits in zip(w, b):
            chunk = np.zeros(CHUNK_BITS // 64, np.int64)
            chunk[places.values.to_numpy()] = bits.values.to_numpy()
            found.append(chunk.tobytes())
        return pa.array(found, pa.binary())

    chunks = words.groupBy("chunk").agg(F.collect_list(F.struct("w", "b")).alias("x")).select("chunk", packed(F.col("x.w"), F.col("x.b")).alias("x"))
    bits = np.zeros(m // 8, np.uint8)
    for r in chunks.toLocalIterator():  # m bits in all
        at_byte = int(r["chunk"]) * CHUNK_BITS // 8
        bits[at_byte:at_byte + CHUNK_BITS // 8] = np.frombuffer(bytes(r["x"]), np.uint8)
    return bits


_PROBED = "_r1 long, _r2 long, _k1 long, _k2 long, _e boolean, n string, own long, a array<long>, b boolean"


def _probe(kinds: Sequence[int], anchors: np.ndarray | None, places: np.ndarray | None):
    """Texts with their hashes -> their anchor ``own``, the anchors ``a`` that some key may have, and whether a key may hold ``own``, ``b``.

    A text without a candidate is null from here on.
    """
    def may(bits: np.ndarray | None, g: np.ndarray) -> np.ndarray:
        if bits is None:
            return np.zeros(len(g), bool)
        mask = np.int64(len(bits) * 8 - 1)
        hit = np.ones(len(g), bool)
        for p in (g & mask, (g.view(np.uint64) >> np.uint64(32)).view(np.int64) & mask):
            hit &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return hit

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, "n"):
                texts, n = Pieces(batch.column("n")), batch.num_rows
                rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for kind in kinds:
                    for row, _, g in texts.windows(kind):
                        hit = may(anchors, g)
                        rows.append(row[hit])
                        found.append(g[hit])
                row, g = np.concatenate(rows), np.concatenate(found)
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
                own, known = np.zeros(n, np.int64), np.zeros(n, bool)
                r, _, h = texts.own()
                own[r[::-1]], known[r] = h[::-1], True  # the first window
                inside = known & (np.bincount(r, ~may(places, h), n) == 0)  # a key that holds the text holds all its windows
                text = batch.column("n").take(pa.array(np.arange(n), mask=~(inside | (np.diff(ends) > 0))))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("_r1", "_r2", "_k1", "_k2", "_e")), text, pa.array(own, mask=~known),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(g[order], pa.int64())), pa.array(inside)],
                    names=["_r1", "_r2", "_k1", "_k2", "_e", "n", "own", "a", "b"])

    return run


def _anchor_join(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(_r1, _r2, pos) of the texts (_r1, _r2, g) and keys (g, pos) of the same anchor; an anchor of many texts is salted by their count."""
    hot = texts.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_TEXTS).select("g", F.ceil(F.col("_n") / HOT_TEXTS).cast("int").alias("_s"))
    hot = F.broadcast(materialize_small(hot))  # at most rows / HOT_TEXTS of them
    salts = F.coalesce("_s", F.lit(1))
    left = texts.join(hot, "g", "left").withColumn("_salt", F.pmod(F.xxhash64("_r1", "_r2"), salts).cast("int")).drop("_s")
    right = keys.join(hot, "g", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_s")
    return left.join(right, ["g", "_salt"]).select("_r1", "_r2", "pos")


def match_texts(df: DataFrame, text_cols: Sequence[str], lookup: DataFrame, empty_matches: bool = True) -> DataFrame:
    """Match the texts of ``df`` -> ``(_r1, _r2, pos, exact)``, once for each distinct raw text; matched texts only."""
    ids = ["_r1", "_r2"]
    send_package(df.sparkSession)
    keys = lookup.select("key", "pos")
    spelled = keys.where(F.col("key") != "")
    windows = spelled.mapInArrow(_key_windows(False), "pos long, g long, kind int")
    shared = windows.groupBy("g").agg(F.count_distinct("pos").alias("n"))
    rarest = windows.join(shared, "g").groupBy("pos").agg(F.min_by(F.struct("g", "kind"), F.struct("n", "g")).alias("x"))
    anchors = materialize_small(rarest.select("pos", "x.g", "x.kind"))
    places = stored(spelled.mapInArrow(_key_windows(True), "pos long, g long, kind int").select("pos", "g").distinct(), "places")
    # one row with a few numbers: what an empty text or key decides, and how large the keys are
    known = keys.agg(F.min("pos").alias("first"), F.min(F.when(F.col("key") == "", F.col("pos"))).alias("empty"), F.sum(F.octet_length("key")).alias("bytes")).first()
    kinds = sorted(r["kind"] for r in anchors.select("kind").distinct().collect())  # at most HEAD + 2
    anchor_bits, place_bits = bloom_bits(anchors.select("g")), bloom_bits(places.select("g"))

    rows = None
    for c in text_cols:
        part = df.select(*raw_key(c), normalize_text(c).alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    hashes = rows.select(*ids, "n", *[h.alias(f"_k{i}") for i, h in enumerate(text_key(F.col("n")), 1)], (F.col("n") == "").alias("_e"))
    # of a text without a candidate only hashes cross the shuffle
    seen = stored(hashes.mapInArrow(_probe(kinds, anchor_bits, place_bits), _PROBED).dropDuplicates(ids), "texts")
    hashed = seen.select(*ids, "_k1", "_k2", "_e")
    wanted = keys.select(*[h.alias(f"_k{i}") for i, h in enumerate(text_key(F.col("key")), 1)], "pos")
    if not empty_matches:
        hashed = hashed.where(~F.col("_e"))
    # ids and positions only, written once: every branch below leaves these texts out
    exact = materialize_small(hashed.join(wanted, ["_k1", "_k2"]).select(*ids, "pos"))

    rest = seen.where("n is not null").select(*ids, "n", "own", "a", "b").join(exact.select(*ids), ids, "left_anti")
    holds = _anchor_join(rest.select(*ids, F.explode(F.array_distinct("a")).alias("g")), anchors.select("g", "pos"))
    inside = _anchor_join(rest.where("b").select(*ids, F.col("own").alias("g")), places)
    found = holds.unionByName(inside).distinct()
    texts = keys.where(F.col("key") != "")
    texts = F.broadcast(texts) if (known["bytes"] or 0) <= KEY_BYTES else texts
    best = (rest.select(*ids, "n").join(found, ids).join(texts, "pos").where(F.contains("n", "key") | F.contains("key", "n"))
            .groupBy(*ids).agg(F.min("pos").alias("pos")))
    if known["empty"] is not None:  # an empty key is in every text
        others = hashed.where(~F.col("_e")).select(*ids).join(exact.select(*ids), ids, "left_anti")
        best = (others.select(*ids, F.lit(known["empty"]).alias("pos")).unionByName(best)
                .groupBy(*ids).agg(F.min("pos").alias("pos")))
    out = exact.select(*ids, "pos", F.lit(True).alias("exact")).unionByName(best.select(*ids, "pos", F.lit(False).alias("exact")))
    if empty_matches and known["empty"] is None and known["first"] is not None:  # an empty text is in every key
        blank = hashed.where("_e").select(*ids, F.lit(known["first"]).alias("pos"), F.lit(False).alias("exact"))
        out = out.unionByName(blank)
    return out


def match_column(df: DataFrame, text_col: str, lookup: DataFrame, empty_matches: bool = True,
                 prefix: str = "", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``{prefix}pos`` and ``{prefix}exact`` (null when unmatched) to ``df`` or to its columns ``keep``.

    With ``keep`` the text itself needn't go through the join.
    """
    m = match_texts(df, [text_col], lookup, empty_matches)
    keyed = df.select(*(keep if keep is not None else ["*"]), *raw_key(text_col))
    # matched texts -> rows: an equi-join on 16 bytes; AQE broadcasts the match table when its
    # runtime size is small and splits skewed keys otherwise
    return (keyed.join(m, ["_r1", "_r2"], "left")
            .withColumnRenamed("pos", f"{prefix}pos").withColumnRenamed("exact", f"{prefix}exact")
            .drop("_r1", "_r2"))


def control_differences(pairs: DataFrame, lookup: DataFrame, n_dims: int, base_pos: str, comp_pos: str,
                        keep: Sequence[str], control_prefix: str = "INTN") -> DataFrame:
    """``keep`` and INTN1..k = control(comparison) - control(base) of matched positions, 0.0 unless both matched."""
    vb = lookup.select(F.col("pos").alias("_bp"), F.col("vec").alias("_bvec"))
    vc = lookup.select(F.col("pos").alias("_cp"), F.col("vec").alias("_cvec"))
    j = (pairs.join(vb, F.col(base_pos) == F.col("_bp"), "left").join(vc, F.col(comp_pos) == F.col("_cp"), "left"))
    b, c = F.col("_bvec").isNotNull(), F.col("_cvec").isNotNull()
    diff = F.when(b & c, F.zip_with("_cvec", "_bvec", lambda x, y: x - y)).otherwise(F.array_repeat(F.lit(0.0), n_dims))
    j = j.withColumn("_diff", diff)
    return j.select(*keep, *[F.col("_diff")[i].alias(f"{control_prefix}{i + 1}") for i in range(n_dims)],
                    (b & c).alias("nuisance_matched"), b.alias("base_matched"), c.alias("comp_matched"),
                    "wc_base", "wc_comparison").withColumn("wc_diff", F.col("wc_comparison") - F.col("wc_base"))


def enrich_pairs(df: DataFrame, base_col: str, comp_col: str, lookup: DataFrame, n_dims: int,
                 empty_matches: bool = True, control_prefix: str = "INTN", keep: Sequence[str] | None = None) -> DataFrame:
    """Attach ``control(comparison) - control(base)`` and word-count differences to ``df`` (or its columns ``keep``).

    Adds INTN1..k (0.0 unless both sides matched), ``nuisance_matched``,
    ``base_matched``, ``comp_matched``, ``wc_base``, ``wc_comparison``, ``wc_diff``.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in ("wc_base", "wc_comparison", "wc_diff")]
    m = match_texts(df, [base_col, comp_col], lookup, empty_matches)
    rows = df.select(*kept, *raw_key(base_col, "_b"), *raw_key(comp_col, "_c"),
                     word_count(base_col).alias("wc_base"), word_count(comp_col).alias("wc_comparison"))
    mb = m.select(F.col("_r1").alias("_b1"), F.col("_r2").alias("_b2"), F.col("pos").alias("_bpos"))
    mc = m.select(F.col("_r1").alias("_c1"), F.col("_r2").alias("_c2"), F.col("pos").alias("_cpos"))
    rows = rows.join(mb, ["_b1", "_b2"], "left").join(mc, ["_c1", "_c2"], "left")
    return control_differences(rows, lookup, n_dims, "_bpos", "_cpos", kept, control_prefix)


def enrich_neighbours(df: DataFrame, id_col: str, text_col: str, lookup: DataFrame, n_dims: int,
                      empty_matches: bool = True) -> DataFrame:
    """``enrich_pairs`` of each row (base) with the row of the next id: ``pair_id`` and the columns added there.

    Each text is matched and counted once; the pair is made of two numbers of
    either side.
    """
    one = match_column(df.withColumn("_wc", word_count(text_col)), text_col, lookup, empty_matches, keep=[id_col, "_wc"])
    sides = F.explode(F.array(F.struct(F.col(id_col).alias("pair_id"), F.lit(True).alias("base")),
                              F.struct((F.col(id_col) - 1).alias("pair_id"), F.lit(False).alias("base"))))
    each = one.select(sides.alias("_s"), "_wc", "pos").select("_s.*", "_wc", "pos")
    pairs = each.groupBy("pair_id").agg(*[F.max(F.when(side, F.col(c))).alias(n) for side, c, n in (
        (F.col("base"), "_wc", "wc_base"), (~F.col("base"), "_wc", "wc_comparison"),
        (F.col("base"), "pos", "_bpos"), (~F.col("base"), "pos", "_cpos"))])
    pairs = pairs.where(F.col("wc_base").isNotNull() & F.col("wc_comparison").isNotNull())
    return control_differences(pairs, lookup, n_dims, "_bpos", "_cpos", ["pair_id"])


def match_rates(enriched: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Counts and percentages of base / comparison / both matched (null % when n = 0)."""
    g = group_cols or []
    n = F.count(F.lit(1))
    agg = [
        n.alias("n"),
        F.count_if("base_matched").alias("matched_base"),
        F.count_if("comp_matched").alias("matched_comp"),
        F.count_if("nuisance_matched").alias("matched_both"),
    ]
    out = enriched.groupBy(*g).agg(*agg)
    for c in ("matched_base", "matched_comp", "matched_both"):
        out = out.withColumn(f"pct_{c.split('_')[1]}",
                             F.when(F.col("n") > 0, F.round(100.0 * F.col(c) / F.col("n"), 4)))
    return out
