"""Line dedup by pairwise alignment.

Every line is hashed.  Documents that share lines overlap: each shared line
pairs a document with the earliest document that holds the line, rare lines
and frequent ones alike, so a line in n documents makes n - 1 pairs and not
n * n, and every line that an earlier document holds is covered by some pair.
Lines of fewer than MIN_WORDS words, which recur by chance, make a pair in runs
that have so many together.  Scripts without blanks count by characters.
A pair is aligned with patience diff: lines unique in both, in the longest
increasing order, are anchors; runs grow from them and the gaps are aligned in
the same way.  Aligned blocks of MIN_WORDS words or more are deleted from the
later document, and so are the blocks that both hold but one alignment leaves:
crossing ones, and ones that the later document has more often.  Alignments read the documents as they came, so the earliest
holder of a line keeps it and no order of work matters.

A document that is the earliest holder for very many others is copied to as
many slots as they need; its partners stream past it one at a time.

Defined results: documents are ordered by doc_id (null first), then by a hash
of the text; rows equal in both are one document and get the same result; a
null text stays null, an empty one empty; texts of any length are read whole;
a document that loses all its lines keeps an empty text; an empty table gives
an empty table; other columns are passed by.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textcontrols.llm.work import arrow_schema, map_columns, require, rows_of, sliced, written

MIN_WORDS = 4
#: Characters that count as a word: of scripts without blanks between words, and of any line.
UNSPACED_CHARS, LINE_CHARS = 2, 40
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
#: Partners of a document in one slot, and salts of the join on line hashes.
SLOT_PAIRS, SALTS = 100, 8

#: Fingerprints of runs of lines: polynomials in BASE modulo a prime.
BASE, PRIME = 0x5A17C3D9E8B24F6180D3A7B5C91E4F27, (1 << 127) - 1

SEQUENCE = "d long, t long, h1 array<long>, h2 array<long>, w array<int>, pairing array<long>"


def weights(lines: list[str], spaced: bool = False) -> list[int]:
    """Words of each line; of scripts without blanks two characters, and of any line 40, count as one at least.

    ``spaced``: no line holds such a script.
    """
    if spaced:
        return [max(len(x.split()), len(x) // LINE_CHARS) for x in lines]
    return [max(len(x.split()), len(x) // LINE_CHARS, sum(map(len, _UNSPACED.findall(x))) // UNSPACED_CHARS) for x in lines]


def _hash_lines(least: int):
    mask, half = (1 << 64) - 1, 1 << 63

    def step(ids, keys, texts):
        for d, t, text in zip(ids, keys, texts):
            lines = text.split("\n")
            whole = [xxhash.xxh3_128_digest(x.strip().encode("utf-8", "surrogatepass")) for x in lines]
            w = weights([x.strip() for x in lines], text.isascii() or not _UNSPACED.search(text))
            numbers = [int.from_bytes(h, "big") for h in whole]
            pairing = {(h >> 64) - half for h, n in zip(numbers, w) if n >= least}
            if any(0 < n < least for n in w):
                pairing.update(xxhash.xxh3_64_intdigest(b"".join(whole[a:b])) - half
                               for a, b in windows(w, least) if b > a + 1 and w[a] and w[b - 1])
            yield (d, t, [(h >> 64) - half for h in numbers], [(h & mask) - half for h in numbers], w, list(pairing))

    return step


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs that rises in both places; pairs come in order of the first."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
        back[i] = at[k - 1] if k else -1
    found, i = [], at[-1] if at else -1
    while i >= 0:
        found.append(pairs[i])
        i = back[i]
    return found[::-1]


def _numbered(items: list, low: int, high: int) -> dict:
    """Place of each item as (item, how often it came before)."""
    seen, place = Counter(), {}
    for i in range(low, high):
        place[items[i], seen[items[i]]] = i
        seen[items[i]] += 1
    return place


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal items, rising in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        anchors = _rising([(j, place[b[j]]) for j in range(b0, b1) if b[j] in place])
        if not anchors:  # no unique line: pair the first with the first, the second with the second, ...
            where = _numbered(a, a0, a1)
            later = sorted((j, where[x]) for x, j in _numbered(b, b0, b1).items() if x in where)
            found += [(i, j) for j, i in _rising(later)]
            continue
        before_a, before_b = a0, b0
        for j, i in [*anchors, (b1, a1)]:
            todo.append((before_a, i, before_b, j))
            if j < b1:
                found.append((i, j))
            before_a, before_b = i + 1, j + 1
    return sorted(found)


def windows(words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """Shortest runs of lines of ``least`` words or more, from each line on and up to each line, as (start, end).

    Any run of so many words is covered by those of them that lie in it.
    """
    total = [0, *accumulate(words)]
    for start in range(len(words)):
        end = bisect_left(total, total[start] + least)
        if end < len(total):
            yield start, end
    for end in range(1, len(total)):
        if total[end] >= least:
            yield bisect_right(total, total[end] - least) - 1, end


def _prints(lines: list, of: dict) -> list[int]:
    """Fingerprints of the lines up to each place."""
    found = [0]
    for x in lines:
        found.append((found[-1] * BASE + of.setdefault(x, len(of) + 1)) % PRIME)
    return found


def common_runs(a: list, b: list, words: list[int], least: int) -> set[int]:
    """Places of ``b`` that lie in a run of ``least`` words or more that ``a`` holds too; ``words`` are those of b's lines."""
    of: dict = {}
    size = dict(zip(b, words))
    power = [1]
    for _ in range(max(len(a), len(b))):
        power.append(power[-1] * BASE % PRIME)

    def runs(lines: list, counts: list[int]) -> Iterator[tuple[tuple[int, int], int, int]]:
        upto = _prints(lines, of)
        for s, e in windows(counts, least):
            yield (e - s, (upto[e] - upto[s] * power[e - s]) % PRIME), s, e

    of_b = list(runs(b, words))
    held = {key for key, _, _ in runs(a, [size.get(x, least) for x in a])}
    gone, at = set(), [0] * (len(b) + 1)
    for key, s, e in of_b:
        if key in held:
            at[s] += 1
            at[e] -= 1
    for place, n in enumerate(accumulate(at[:-1])):
        if n:
            gone.add(place)
    return gone


def deletions(a: list, b: list, words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Places in the later document ``b`` that lie in blocks of ``least`` words or more of the earlier one.

    One alignment leaves what crosses it, or comes more often in ``b``.  If a
    line of ``a`` is left, every block common to both is taken, whatever its
    order, so that none stays.
    """
    gone: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(a, b), (-2, -2)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least:
                gone += block
            block = []
        block.append(j)
        last = i, j
    out, held = set(gone), set(a)
    if any(words[j] and j not in out and x in held for j, x in enumerate(b)):
        out |= common_runs(a, b, words, least)
    return sorted(out)


OUT = "d long, t long, gone array<int>"


def _align(least: int):
    """Rows (fd, ft, slot, later, d, t, h1, h2, w), the earlier document before its partners -> places to delete."""
    target = arrow_schema(OUT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, []
        for batch in batches:
            found = []
            for fd, ft, slot, later, d, t, h1, h2, w in rows_of([batch]):
                lines = list(zip(h1, h2))
                if not later:
                    key, first = (fd, ft, slot), lines
                elif (fd, ft, slot) == key and (gone := deletions(first, lines, w, least)):
                    found.append((d, t, gone))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), target)], schema=target)

    return run


def _d(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def overlaps(sequences: DataFrame) -> DataFrame:
    """(fd, ft, d, t): each document with the earliest holder of each of its shared lines and runs of short lines."""
    lines = sequences.select("d", "t", F.explode("pairing").alias("h"))
    holder = F.struct("d", "t")
    shared = (lines.groupBy("h").agg(F.min(holder).alias("first"), F.max(holder).alias("last")).where("first <> last")
              .select("h", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("d", "t"), F.lit(SALTS)).cast("int"))
    return (salted.join(shared, ["h", "salt"]).where(F.col("first") < holder)
            .select(F.col("first.d").alias("fd"), F.col("first.t").alias("ft"), "d", "t").distinct())


def places_to_delete(docs: DataFrame, doc_id: str, text: str, least: int = MIN_WORDS) -> DataFrame:
    """(d, t, gone): document keys and the places of the lines that go."""
    keyed = docs.select(_d(F.col(doc_id)).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x")).where(F.col("x").isNotNull())
    sequences = written(map_columns(keyed, lambda: _hash_lines(least), SEQUENCE).dropDuplicates(["d", "t"]), "lines")
    pairs = written(overlaps(sequences), "pairs")
    slots = pairs.groupBy("fd", "ft").agg(F.ceil(F.count(F.lit(1)) / SLOT_PAIRS).cast("int").alias("slots"))
    later = (pairs.join(slots, ["fd", "ft"]).withColumn("slot", F.pmod(F.xxhash64("d", "t"), F.col("slots")).cast("int"))
             .join(sequences, ["d", "t"]).select("fd", "ft", "slot", F.lit(True).alias("later"), "d", "t", "h1", "h2", "w"))
    first = (slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
             .withColumnsRenamed({"fd": "d", "ft": "t"}).join(sequences, ["d", "t"])
             .select(F.col("d").alias("fd"), F.col("t").alias("ft"), "slot", F.lit(False).alias("later"), "d", "t", "h1", "h2", "w"))
    place = ["fd", "ft", "slot"]
    found = first.union(later).repartition(*place).sortWithinPartitions(*place, "later").mapInArrow(_align(least), OUT)
    return found.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def _left(texts: pa.Array, gone: pa.Array) -> pa.Array:
    def left(text, places):
        if text is None or not places:
            return text
        out = set(places)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)

    return pa.array([left(t, g) for t, g in zip(sliced(texts), sliced(gone))], pa.string())


_without = F.arrow_udf(_left, StringType())
#: Not to be repeated: a condition on its result would otherwise be a second call, in a second worker for each task.
_without_once = F.arrow_udf(_left, StringType()).asNondeterministic()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS, once: bool = False) -> DataFrame:
    """``row`` (struct of all columns of ``docs``), ``left`` (the text that stays), n_lines and n_removed_lines of every row.

    ``once``: ``left`` is made by one call, whatever conditions on it follow; all columns of ``docs`` are then read.
    """
    require(docs, doc_id, text)
    gone = places_to_delete(docs, doc_id, text, least)
    rows = docs.select(F.struct("*").alias("row"), _d(F.col(doc_id)).alias("d"), F.xxhash64(text).alias("t"))
    full = rows.join(gone, ["d", "t"], "left")
    value = F.col("row").getField(text)
    lines = F.when(value.isNull(), 0).otherwise(F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1)
    return full.select("row", (_without_once if once else _without)(value, F.col("gone")).alias("left"), lines.cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"))
