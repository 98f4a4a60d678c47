"""CSV files with quoted line ends, each read by many tasks.

A reader of quoted fields that span lines must know whether it stands inside quotes, which
depends on everything before.  Here a file is read as ranges of whole lines (the
text source splits files of any store that Spark reads):

1. each range says, for both states it may begin in, in which it ends and
   whether a record begins in it; a few values for each range;
2. running through the ranges of a file fixes the state that each begins in and the range
   where the record that is open there began;
3. the ranges are read again, each from its known state: records that lie in
   one range go on at once, only pieces of records that cross ranges are
   shuffled and joined;
4. each record is parsed by Spark's own CSV parser.

A quote opens a field only at its start, so quotes within unquoted fields are
plain characters.  Records end in \\n or \\r\\n; empty lines are no records.  The
first record of each file is its header; names come from the first file.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textcontrols.session import send_package

QUOTE, COMMA = '"', ","

#: Kinds of output: a whole record, the end of a record begun before, the middle of one, a record that goes on.
WHOLE, TAIL, MIDDLE, OPEN = range(4)


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether the state after a line is inside quotes."""
    at, n = 0, len(line)
    while at < n:
        if quoted:
            close = line.find(QUOTE, at)
            if close < 0:
                return True
            if line.startswith(QUOTE, close + 1):  # a doubled quote
                at = close + 2
                continue
            quoted, at = False, close + 1
            field = line.find(COMMA, at)  # what follows a closing quote belongs to the field
            if field < 0:
                return False
            at = field + 1
        elif line[at] == QUOTE:
            quoted, at = True, at + 1
        else:
            field = line.find(COMMA, at)
            if field < 0:
                return False
            at = field + 1
    return quoted


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")))


def _by_range(batches) -> Iterator[tuple[tuple, list[str]]]:
    """Runs of lines of one range, in order; a range may come in several."""
    for batch in batches:
        file, start, line = (c.to_pylist() for c in batch.columns)
        at = 0
        for i in range(1, len(line) + 1):
            if i == len(line) or (file[i], start[i]) != (file[at], start[at]):
                yield (file[at], start[at]), line[at:i]
                at = i


def _states(batches) -> Iterator[pa.RecordBatch]:
    """One row for each range: the states it ends in and whether a record begins, from both states."""
    key, now, begins = None, [False, True], [False, False]

    def row():
        return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "out_ends": now[0], "in_ends": now[1],
                                            "out_begins": begins[0], "in_begins": begins[1]}])

    for range_key, lines in _by_range(batches):
        if range_key != key:
            if key:
                yield row()
            key, now, begins = range_key, [False, True], [False, False]
        for line in lines:
            begins = [b or not q for b, q in zip(begins, now)]
            if QUOTE in line:
                now = [ends_quoted(line, q) for q in now]
    if key:
        yield row()


_STATES = "file string, start long, out_ends boolean, in_ends boolean, out_begins boolean, in_begins boolean"
_PIECES = "file string, start long, nth long, kind int, text string"


def _pieces(first: dict[tuple, bool]):
    """Records and pieces of records; ``first`` holds the ranges that begin inside quotes."""
    def run(batches):
        key, quoted, held, nth, begun = None, False, [], 0, False

        def rows(found):
            file, start, n, kind, text = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(file), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(kind, pa.int32()),
                                               pa.array(text, pa.string())], names=["file", "start", "nth", "kind", "text"])

        def rest():
            return [(*key, nth, OPEN if begun else MIDDLE, "\n".join(held))] if held else []

        for range_key, lines in _by_range(batches):
            found = []
            if range_key != key:
                found += rest()
                key, held, nth, begun = range_key, [], 0, False
                quoted = first.get(key, False)
            for line in lines:
                if not quoted and not held:
                    begun = True
                held.append(line)
                if QUOTE in line:
                    quoted = ends_quoted(line, quoted)
                if not quoted:
                    found.append((*key, nth, WHOLE if begun else TAIL, "\n".join(held)))
                    held, nth, begun = [], nth + 1, False
            if found:
                yield rows(found)
        if key and (found := rest()):
            yield rows(found)

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, nth, text): the records of CSV files; ``start`` and ``nth`` order the records of a file."""
    send_package(spark)
    lines = _lines(spark, path)
    states = lines.mapInArrow(_states, _STATES)
    # a few values for each range: the number of ranges is that of the scan's tasks, which the driver plans anyway
    inside, opener = {}, {}
    state = before = file = None
    for r in sorted(states.collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state, before = r["file"], False, None
        if state:
            inside[file, r["start"]] = True
            opener[file, r["start"]] = before
        if r["in_begins"] if state else r["out_begins"]:
            before = r["start"]
        state = r["in_ends"] if state else r["out_ends"]
    found = lines.mapInArrow(_pieces(inside), _PIECES)
    if not inside:
        return found.select("file", "start", "nth", "text")
    began = spark.createDataFrame([(f, s, o) for (f, s), o in opener.items()], "file string, start long, began long")
    whole = found.where(F.col("kind") == WHOLE).select("file", "start", "nth", "text")
    parts = found.where(F.col("kind") != WHOLE).join(F.broadcast(began), ["file", "start"], "left")  # a row for each open range
    home = F.when(F.col("kind") == OPEN, F.col("start")).otherwise(F.col("began"))
    joined = (parts.select("file", home.alias("home"), "start", "nth", "kind", "text").groupBy("file", "home")
              .agg(F.array_sort(F.collect_list(F.struct("start", "nth", "text"))).alias("p"), F.max(F.when(F.col("kind") == OPEN, F.col("nth"))).alias("nth")))
    return whole.unionByName(joined.select("file", F.col("home").alias("start"), "nth", F.array_join("p.text", "\n").alias("text")))


def _names(header: str) -> list[str]:
    """Column names of a header record: an empty one is _c and its place, one that comes again gets its place added."""
    found = next(csv.reader(io.StringIO(header.removeprefix("\ufeff"))))
    lower = [c.lower() for c in found]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(found)]


def read_csv_ranges(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All columns of CSV files as text; the first record of each file is its header; ``options`` go to Spark's CSV parser."""
    found = records(spark, path).withColumn("text", F.regexp_replace("text", r"\r$", ""))
    header = (F.col("start") == 0) & (F.col("nth") == 0)
    head = found.where(header & (F.col("text") != "")).agg(F.min(F.struct("file", "text")).alias("h")).first()["h"]
    if head is None:
        return spark.createDataFrame([], StructType([]))
    schema = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in _names(head["text"]))
    rows = found.where(~header & (F.col("text") != ""))
    return rows.select(F.from_csv("text", schema, {"escape": QUOTE, **options}).alias("r")).select("r.*")
