"""Ordered matching: the literal fixture and the traps of empty/null text."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textcontrols.operators import match
from textcontrols.operators.match import build_lookup, enrich_pairs, match_column, match_rates

LOOKUP = [(0, "alpha beta", 1.0, 2.0), (1, "alpha beta gamma", 3.0, 5.0), (2, "delta", 7.0, 11.0)]
QUERIES = ["Alpha Beta™", "xx delta yy", "alpha beta gamma", "alpha", "", None, "nope", " DELTA ®", "beta gamma"]
EXPECTED = [0, 2, 1, 0, 0, 0, None, 2, 1]


def _lookup(spark, rows=LOOKUP):
    cat = spark.createDataFrame(rows, "pos long, text string, a double, b double")
    return build_lookup(cat, "text", "pos", ["a", "b"])


def test_first_match_fixture(spark):
    q = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, text string")
    out = match_column(q, "text", _lookup(spark)).orderBy("qid").select("pos").collect()
    assert [r[0] for r in out] == EXPECTED


def test_empty_text_unmatched_when_disabled(spark):
    q = spark.createDataFrame([(0, ""), (1, None), (2, "delta")], "qid int, text string")
    out = match_column(q, "text", _lookup(spark), empty_matches=False).orderBy("qid").select("pos").collect()
    assert [r[0] for r in out] == [None, None, 2]


def test_exact_beats_earlier_containment(spark):
    # "alpha beta gamma" contains key 0 but equals key 1: the exact hit wins
    q = spark.createDataFrame([(0, "ALPHA BETA GAMMA ")], "qid int, text string")
    out = match_column(q, "text", _lookup(spark)).collect()[0]
    assert out["pos"] == 1 and out["exact"] is True


def test_repeated_key_keeps_first_position_last_value(spark):
    rows = [(5, "Same", 1.0, 1.0), (2, "other", 0.0, 0.0), (9, "same", 4.0, 4.0)]
    lk = {r["key"]: (r["pos"], list(r["vec"])) for r in _lookup(spark, rows).collect()}
    assert lk["same"] == (5, [4.0, 4.0])


def test_vector_diff_and_flags(spark):
    pairs = spark.createDataFrame([(0, "alpha beta", "delta"), (1, "delta", "zzz")],
                                  "pid int, Text_Base string, Text_Comparison string")
    e = enrich_pairs(pairs, "Text_Base", "Text_Comparison", _lookup(spark), 2).orderBy("pid").collect()
    assert [e[0]["INTN1"], e[0]["INTN2"], e[0]["nuisance_matched"]] == [6.0, 9.0, True]
    assert [e[1]["INTN1"], e[1]["INTN2"], e[1]["nuisance_matched"]] == [0.0, 0.0, False]
    assert e[0]["wc_diff"] == -1
    r = match_rates(spark.createDataFrame([], "base_matched boolean, comp_matched boolean, nuisance_matched boolean"))
    assert r.collect()[0]["pct_both"] is None  # n = 0: no division


def test_anchors_find_every_containment(spark):
    """Random strings of few words and characters against the plain rule, blanks at ends and empty ones included."""
    import random
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    text = lambda most: rng.choice(["", " ", "™ "]) + rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randint(0, most)))
    for with_empty in (False, True):
        keys = [(i, t, 0.0, 0.0) for i, t in enumerate(text(6) for _ in range(40)) if with_empty or t.replace("™", "").strip()]
        queries = [(i, text(9)) for i in range(150)]
        norm = lambda t: t.strip().lower().replace("™", "")
        lookup = {}
        for p, t, _, _ in keys:
            lookup.setdefault(norm(t), p)
        want = {}
        for i, t in queries:
            n = norm(t)
            want[i] = lookup.get(n, min((p for k, p in lookup.items() if k in n or n in k), default=None))
        got = match_column(spark.createDataFrame(queries, "qid int, text string"), "text", _lookup(spark, keys)).collect()
        assert {r.qid: r.pos for r in got} == want


def test_result_independent_of_partitioning(spark):
    q = spark.createDataFrame(list(enumerate(QUERIES * 5)), "qid int, text string")
    a = match_column(q.repartition(1), "text", _lookup(spark)).orderBy("qid").select("pos").collect()
    b = match_column(q.repartition(7), "text", _lookup(spark)).orderBy("qid").select("pos").collect()
    assert a == b


def test_empty_lookup_all_unmatched(spark):
    empty = _lookup(spark, [])
    q = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, text string")
    assert {r.pos for r in match_column(q, "text", empty).collect()} == {None}
    pairs = spark.createDataFrame([(0, "a", "b")], "pid int, Text_Base string, Text_Comparison string")
    e = enrich_pairs(pairs, "Text_Base", "Text_Comparison", empty, 2).collect()[0]
    assert (e.INTN1, e.INTN2, e.nuisance_matched) == (0.0, 0.0, False)


def test_only_texts_with_a_candidate_are_exchanged(spark, monkeypatch):
    """Of the other texts the table that is shuffled holds hashes only; a key's anchor is the window that the fewest keys share."""
    from textcontrols.operators import match as M
    seen = {}
    real = M.stored
    monkeypatch.setattr(M, "stored", lambda df, name="stage": seen.setdefault(name, real(df, name)))
    keys = [(i, f"start of the usual opening words then item{i} part{i} piece{i} and end", 0.0, 0.0) for i in range(30)]
    texts = [(i, f"the usual opening words of text number {i} tell nothing that a key holds") for i in range(300)]
    texts += [(1000 + i, f"before {keys[i][1]} after") for i in range(30)]
    got = match_column(spark.createDataFrame(texts, "qid int, text string"), "text", _lookup(spark, keys)).collect()
    assert {r.qid: r.pos for r in got} == {i: i - 1000 if i >= 1000 else None for i, _ in texts}
    assert seen["texts"].where("n is not null").count() == 30 and seen["texts"].count() == 330


def test_a_frequent_anchor_is_spread(spark, monkeypatch):
    """Keys of which the only inner word is in every text: its texts are joined in parts, to the same result."""
    from textcontrols.operators import match as M
    monkeypatch.setattr(M, "HOT_TEXTS", 50)
    keys = [(0, "of the town", 0.0, 0.0), (1, "in the river", 0.0, 0.0)]
    texts = [(i, f"word{i} {'of the town' if i % 3 == 0 else 'in the river' if i % 3 == 1 else 'by the sea'} word{i}") for i in range(600)]
    got = match_column(spark.createDataFrame(texts, "qid int, text string"), "text", _lookup(spark, keys)).collect()
    assert {r.qid: r.pos for r in got} == {i: (i % 3 if i % 3 < 2 else None) for i, _ in texts}
    hot = spark.createDataFrame([(i, -i, 7) for i in range(600)], "_r1 long, _r2 long, g long")
    plan = M._anchor_join(hot, spark.createDataFrame([(7, 0)], "g long, pos long"))
    assert plan.count() == 600
    salts = hot.select(F.pmod(F.xxhash64("_r1", "_r2"), F.lit(12)).alias("s")).groupBy("s").count().collect()
    assert len(salts) == 12 and max(r["count"] for r in salts) <= 2 * sorted(r["count"] for r in salts)[6]


def test_windows_in_pieces(monkeypatch):
    """Windows cut at any place are those of each text by itself."""
    texts = ["", "alpha beta gamma delta epsilon zeta", None, "ab", "é漢🙂 x", "a", " lone ", "one two three four"]
    whole = {kind: np.concatenate([np.stack(w) for w in match.Pieces(pa.array(texts)).windows(kind)], axis=1) for kind in (1, 3, match.ONE_WORD, match.THREE_WORDS)}
    own = np.stack(match.Pieces(pa.array(texts)).own())
    for size in (1, 2, 5):
        monkeypatch.setattr(match, "WINDOWS", size)
        pieces = match.Pieces(pa.array(texts))
        for kind, want in whole.items():
            assert np.array_equal(np.concatenate([np.stack(w) for w in pieces.windows(kind)], axis=1), want)
        assert np.array_equal(np.stack(pieces.own()), own)
    for kind, want in whole.items():
        sizes = [0 if t is None else len(t.split(" ")) if kind >= match.ONE_WORD else len(t) for t in texts]
        wide = 3 if kind == match.THREE_WORDS else 1 if kind == match.ONE_WORD else kind
        assert want[:2].T.tolist() == [[i, j] for i, n in enumerate(sizes) for j in range(n - wide + 1)]


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(match, "SLICE_BYTES", 10)
    monkeypatch.setattr(match, "SLICE_ROWS", 3)
    texts = ["", None, "abc", "x" * 50, "", "abcdefghij", "k", None, None, None, "é" * 4]
    parts = [b.column("t").to_pylist() for b in match._slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"]), "t")]
    assert sum(parts, []) == texts
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10) for p in parts)


def held_mb(step, batch) -> float:
    tracemalloc.start()
    for _ in step(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_memory_of_a_task_is_bounded():
    """Neither many texts nor long ones are taken apart as a whole."""
    words = " ".join(f"w{i % 700}" for i in range(900))
    n = 1000
    keys = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([words] * n)], names=["pos", "key"])
    assert held_mb(match._key_windows(True), keys) < 60
    numbers = [pa.array(range(n))] * 4
    names = ["_r1", "_r2", "_k1", "_k2", "_e", "n"]
    texts = pa.RecordBatch.from_arrays([*numbers, pa.array([False] * n), pa.array([words] * n)], names=names)
    one = pa.RecordBatch.from_arrays([*(c.slice(0, 1) for c in texts.columns[:5]), pa.array([" ".join([words] * 500)])], names=names)
    bits = np.zeros(8192, np.uint8)
    for batch in (texts, one):
        assert held_mb(match._probe([1, 4, match.THREE_WORDS], bits, bits), batch) < 80
