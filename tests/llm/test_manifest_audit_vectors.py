"""Merkle manifest, filter audit and embedding dedup against brute force and awkward inputs."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

from textcontrols.llm import embedding_dedup, filter_audit, merkle
from textcontrols.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- Merkle -------------------------------------------------------------

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_way(levels, at):
    """(siblings before, siblings after) level by level."""
    way = []
    for level in levels[:-1]:
        run = level[at - at % 16:at - at % 16 + 16]
        way.append((run[:at % 16], run[at % 16 + 1:]))
        at //= 16
    return way


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted result rows."""
    first = lambda v: (v is not None, v if v is not None else 0)
    leaf = lambda d, t, lang, s, n: digest(*map(said, (d, s, lang, n, t)))
    parts = {}
    for r in rows:
        parts.setdefault(r[3], []).append(r)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(parts[s], key=lambda r: (first(r[0]), leaf(*r))) for s in names}
    levels = {s: plain_levels([leaf(*r) for r in trees[s]]) for s in names}
    over = plain_levels([levels[s][-1][0] for s in names])
    root, out = over[-1][0], []
    for k, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            way = plain_way(levels[s], i) + plain_way(over, k)
            proof = digest(*[x for before, after in way for x in before + after])
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r[0], r[1].translate(LOWER) if hit and r[1] is not None else r[1], *r[2:])
            for before, after in way:
                node = digest(*before, node, *after)
            out.append((r[0], leaf(*r), levels[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


def docs_like(sizes, seed=3):
    rng, rows, at = random.Random(seed), [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            at += rng.randint(1, 3)
            rows.append((at, rng.choice(["Upper Text", "lower", "", None, "é漢🙂 X"]) , rng.choice(["en", None]), None if k == 0 else f"s{k}é"[:k % 4 + 1] + str(k), rng.choice([None, 7])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [[1], [16], [257, 17, 256, 15, 16, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 40], [0, 8200, 4096, 4097]])
def test_merkle_equals_plain(spark, sizes):
    rows = docs_like(sizes)
    assert manifest_rows(merkle.audit(spark.createDataFrame(rows, DOCS))) == plain_manifest(rows)


def test_merkle_layers_of_the_parts(spark):
    """Small blocks: several layers of blocks in the parts and over them."""
    rows = docs_like([300] + [1] * 290 + [20])
    assert manifest_rows(merkle.audit(spark.createDataFrame(rows, DOCS), levels=1)) == plain_manifest(rows)


def test_merkle_awkward(spark, corpus, empty):
    assert merkle.audit(empty).collect() == []
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in corpus.collect()]
    assert manifest_rows(merkle.audit(corpus)) == plain_manifest(rows)
    one = [(None, None, None, None, None)]
    assert manifest_rows(merkle.audit(spark.createDataFrame(one, DOCS))) == plain_manifest(one)


def test_merkle_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.collect()]
    assert manifest_rows(QUERIES["op11_merkle"](spark, SF)) == plain_manifest(rows)


@pytest.mark.parametrize("levels", [1, 2, 3, 4])
def test_layout_is_van_emde_boas(levels):
    """Every node has a place of its own, and each aligned subtree of half the height lies in one stretch."""
    at = {(d, i): int(merkle.address(levels, d, np.array([i]))[0]) for d in range(levels) for i in range(16 ** d)}
    assert sorted(at.values()) == list(range(merkle.nodes_of(levels)))
    top = levels // 2
    for i in range(16 ** top if levels > 1 else 0):
        own = sorted(at[top + d, i * 16 ** d + j] for d in range(levels - top) for j in range(16 ** d))
        assert own == list(range(own[0], own[0] + merkle.nodes_of(levels - top)))


# --- filter audit -------------------------------------------------------

def plain_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    good, bad = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        rows.append((s or "", {k for k, v in fails.items() if v}, d in good, d in bad))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [r for r in own if f in r[1] and not r[1] & before]
                total[f] += len(here)
                out[part, "".join(order), step] = [
                    sum(not r[1] & (before | {f}) for r in own), len(here), sum(f in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in df.collect()}


def audit_rows(n, seed):
    rng = random.Random(seed)
    texts = ["", "x", " ".join(f"word{i}" for i in range(60)), " ".join(["Same"] * 70), "A B C $ " + " ".join(map(str, range(80))),
             "# " + " ".join(f"w{i}" for i in range(49)), " ".join(f"Up{i}" for i in range(55)) + "\t|\n"]
    docs = [(rng.choice([None, rng.randint(0, 3 * n)]) if rng.random() < .1 else i * 7 % n, rng.choice([None, *texts]), rng.choice([None, "", "p", "q"])) for i in range(n)]
    labels = [(rng.randint(0, n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)] + [(None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("files,batches,seed", [(1, 4, 1), (7, 7, 2), (6, 3, 3)])
def test_audit_equals_plain(spark, tmp_path, files, batches, seed):
    """Later micro-batches bring smaller ids, so earlier counts are taken back."""
    docs, labels = audit_rows(150, seed)
    schema = "doc_id long, text string, source string, part string, mask int, key string"
    table = spark.createDataFrame([(*r, "x", 1, "k") for r in docs], schema)
    path = str(tmp_path / "documents.parquet")
    table.repartition(files).write.parquet(path)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(filter_audit.audit(spark, path, said, batches=batches)) == plain_audit(docs, labels)


def test_audit_text_ids_and_no_rows(spark, tmp_path):
    docs = [("b", "t", "p"), ("a", "t", "p"), ("b", "t", "p"), (None, "t", "q")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id string, text string, source string").coalesce(1).write.parquet(path)
    labels = [("a", 1, 0), ("b", 0, 1)]
    said = spark.createDataFrame(labels, "doc_id string, quality int, toxic int")
    assert audited(filter_audit.audit(spark, path, said)) == plain_audit(docs, labels)
    none = str(tmp_path / "none.parquet")
    spark.read.parquet(path).limit(0).write.parquet(none)
    assert filter_audit.audit(spark, none, said.limit(0)).collect() == []


def test_audit_goes_on_where_it_stopped(spark, tmp_path):
    """A second run in the same folder reads new files only and retracts what they change."""
    docs, labels = audit_rows(80, 5)
    path, work = str(tmp_path / "documents.parquet"), str(tmp_path / "work")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    late = sorted(docs, key=lambda r: -1 if r[0] is None else -r[0])
    for part in (late[:40], late[40:]):
        spark.createDataFrame(part, "doc_id long, text string, source string").coalesce(2).write.mode("append").parquet(path)
        spark.catalog.refreshByPath(path)
        found = filter_audit.counters(spark, path, said, work=work, buckets=3).collect()
    assert sum(r["n"] for r in found) == len(docs) and all(r["n"] > 0 for r in found)
    assert audited(filter_audit.over_orders(spark.createDataFrame(found, "part string, mask int, label int, n long"))) == plain_audit(docs, labels)


def test_state_holds_no_disk_in_reserve(spark, tmp_path):
    """A store for each partition: what they reserve of the disk counts, not what they have written."""
    path, began = str(tmp_path / "documents.parquet"), time.time()
    docs, labels = audit_rows(60, 2)
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    filter_audit.counters(spark, path, said).collect()
    local = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    files = [f for f in Path(local).glob("spark-*/StateStoreId*/**/MANIFEST*") if f.stat().st_mtime >= began - 1]
    assert files  # the stores are open still
    assert max(f.stat().st_blocks * 512 for f in files) < 1 << 20


def test_arrive_retracts():
    state, seen = {}, filter_audit.Counters()
    filter_audit.arrive(state, "k", 4, 9, [("p", 1, 2)], [], seen)
    assert seen.n == {("p", 4, 1): 2}
    filter_audit.arrive(state, "k", 4, 3, [("q", 0, 1)], [("p", 0, 5)], seen)
    assert seen.n == {("p", 4, 1): 0, ("p", 20, 1): 2, ("q", 4, 0): 1, ("p", 20, 0): 5}
    assert json.loads(json.dumps(state)) == {"k": [3, [["q", 0, 1]]]}


# --- embeddings ---------------------------------------------------------

def plain_links(rows, cosine=0.9):
    """rows: (vec_id, list) -> per row (vec_id, n_links, component_id, kept)."""
    units = []
    for _, v in rows:
        x = None
        if v and all(a is not None and math.isfinite(a) for a in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            x = x / np.linalg.norm(x)
        units.append(x)
    n, links = len(rows), [set() for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        a, b = units[i], units[j]
        if a is not None and b is not None and len(a) == len(b) and (rows[i][1] == rows[j][1] or a @ b >= cosine):
            links[i].add(j)
            links[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            least = min(ids) if ids else None
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return sorted(out, key=str)


def vector_rows(n, dims, seed, copies=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dims))
    rows = []
    for i in range(n):
        c = centres[rng.integers(len(centres))]
        away = rng.normal(size=dims)
        away *= rng.uniform(0.05, 0.8) * np.linalg.norm(c) / np.linalg.norm(away)
        rows.append((i, [float(np.float32(v)) for v in c + away]))
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


def linked(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,dims,seed", [(1, 3, 0), (300, 2, 1), (500, 7, 2), (900, 64, 3)])
def test_vectors_equal_plain_at_full_margin(spark, n, dims, seed):
    """With the margin of the distance itself no link is lost, whatever the vectors."""
    rows = vector_rows(n, dims, seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert linked(embedding_dedup.dedup(df, margin=1.0)) == plain_links(rows)


def test_vectors_recall_of_borderline_pairs(spark):
    """Pairs of a cosine just over 0.9 in many dimensions: nearly all are found at the default margin, none below 0.9."""
    rng, rows = np.random.default_rng(8), []
    for i in range(1500):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.901 * a + math.sqrt(1 - 0.901 ** 2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = linked(embedding_dedup.dedup(df)), plain_links(rows)
    share = sum(r[1] for r in found) / sum(r[1] for r in want)
    assert 0.97 <= share <= 1
    assert all(a[1] <= b[1] for a, b in zip(found, want))


def test_vectors_awkward(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "COPIES", 10)
    bad = [(1000, None), (1001, []), (1002, [0.0, 0.0]), (1003, [1.0, None]), (1004, [float("nan"), 1.0]), (1005, [float("inf"), 1.0]), (None, [3.0, 4.0]),
           (None, None), (1006, [3.0, 4.0]), (1006, [3.0, 4.0]), (1007, [6.0, 8.0]), (1008, [3.0, 4.0, 0.0]), (1009, [3e300, 4e300]), (1010, [1e-300, 0.0])]
    rows = vector_rows(200, 5, 4) + bad
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, size string, cid int, root int")
    assert linked(embedding_dedup.dedup(df, margin=1.0)) == plain_links(rows)
    assert embedding_dedup.dedup(df.limit(0)).collect() == []


def test_code_errors_bound_the_look_ups():
    """No pair that links is excluded by its code."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + 0.2 * rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = embedding_dedup.fit(x, len(x), 0.9, margin=1.0)
    own, probes, code, error, bias = embedding_dedup.index_rows(model, x)
    for k in np.unique(own):
        at = np.flatnonzero(own == k)
        block = embedding_dedup.Block(model, 0.9, [dict(list=int(k), cid=int(i), size=1, vec=x[i].tobytes(), own=int(k), probes=np.flatnonzero(probes[i]).tolist(),
                                                        code=code[i].tobytes(), error=float(error[i]), bias=float(bias[i])) for i in at])
        q, e = block.near(x.astype(np.float32), np.arange(len(at)))
        kept = set(zip(q.tolist(), at[e].tolist()))
        assert all((int(i), int(j)) in kept for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if j in set(at.tolist()))
