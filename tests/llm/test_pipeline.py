"""The pipeline's stages against brute force, and its awkward inputs."""

import collections
import re
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from textcontrols.llm import line_dedup, ngram_join, secrets
from textcontrols.llm.queries import PATTERN, RANKS
from textcontrols.llm.work import written

from .test_operators import brute_join, brute_lines, check_pieces, pairs_of

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_join", "secret_scan", "packing"]
    good = written(stages["quality_classifier"](spark, docs, SF), "t")
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good.collect()}
    right = [(d in ids) == bool(y) for d, y in label.items()]
    assert good.columns == docs.columns and sum(right) >= 0.9 * len(right)

    lines = written(stages["line_dedup"](spark, good, SF), "t")
    want = brute_lines(sorted(pairs_of(good)))
    before = dict(pairs_of(good))
    assert dict(pairs_of(lines)) == {d: t for d, t in want.items() if t.strip() or t == before[d]}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = written(stages["ngram_join"](spark, lines, SF), "t")
    keep = {d for d, _, c in brute_join(pairs_of(lines), 5, 80) if d == c}
    assert {r["doc_id"] for r in single.collect()} == keep and single.columns == docs.columns

    masked = written(stages["secret_scan"](spark, single, SF), "t")
    assert masked.count() == single.count()
    find = secrets.finder(RANKS, PATTERN)
    for d, t in pairs_of(masked):
        rest = t.replace(secrets.PLACEHOLDER, "")
        assert not re.search(r"AKIA[A-Z0-9]{16}", rest)
        assert (secrets.PLACEHOLDER in t) == bool(find(dict(pairs_of(single))[d])) if d % 7 == 0 else True

    pieces = stages["packing"](spark, masked, SF).collect()
    check_pieces(pieces, pairs_of(masked), 2048)
    assert collections.Counter(map(tuple, P.run(spark, SF).drop("sequence_id").collect())) == collections.Counter(
        tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")) for r in pieces)


def test_awkward_rows(spark, corpus, empty):
    for table in (corpus, empty):
        docs = table
        for name, stage in P.STAGES:
            out = written(stage(spark, docs, SF), "t")
            if name != "packing":
                assert out.columns == table.columns, name
                docs = out
        assert (out.count() == 0) == (table is empty)


def test_lines_are_taken_out_once(spark):
    """The condition on what is left and the text that stays come from one call, in one worker for each task."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = dict(P.STAGES)["line_dedup"](spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def held_mb(step, batch) -> float:
    """Peak of Python's own memory while a step works off a batch."""
    tracemalloc.start()
    for _ in step(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_steps_hold_a_slice_of_a_batch():
    rows, n = 4000, 300
    longs = pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * n, n, dtype=np.int32)), pa.array(np.arange(rows * n) << 32))
    at = pa.array(np.arange(rows))
    asks = [at, at, at, at, pa.array([0] * rows), pa.array([True] * rows), at, pa.array([n] * rows), at, longs]
    assert held_mb(ngram_join._ask_groups(80), pa.RecordBatch.from_arrays(asks, names=[str(i) for i in range(10)])) < 15
    assert held_mb(ngram_join._open_groups(80), pa.RecordBatch.from_arrays([at, at, at, at, longs], names=list("abcde"))) < 15
    lines = [at, at, at, pa.array([True] * rows), at, at, longs, longs, longs]
    assert held_mb(line_dedup._align(4), pa.RecordBatch.from_arrays(lines, names=[str(i) for i in range(9)])) < 25
