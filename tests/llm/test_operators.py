"""Awkward inputs and brute-force results of the training-data operators."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from textcontrols.llm import (
    bpe, components, exact_dedup, html_extraction, licenses, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secrets,
)
from textcontrols.llm.queries import PATTERN, QUERIES, RANKS, TOKENIZER

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, folder=SF):
    return spark.read.parquet(f"{folder}/documents.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- HTML ---------------------------------------------------------------

def simple_article(page):
    """The generator's pages have one article element; its blocks by plain cutting."""
    import html as h
    inner = re.search(r"(?s)<article>(.*?)(</article>|\Z)", page)[1].split("<footer>")[0]
    parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_html_equals_plain_cutting(spark):
    rows = QUERIES["op1_html_extraction"](spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    assert all(r["text"] == simple_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &lt;text&gt; &amp; more", "plain <text> & more"),
    ("<body><nav><a href=a>menu</a></nav><div class='content'><h1>T</h1><p>First long enough paragraph here.<p>Second\n  one &eacute;."
     "<form>name <input></form></div><div class='sidebar'><p>Side side side side side side side</p></div>"
     "<section id='comments'><p>Reader says a great deal more than the article itself does say here</p></section>"
     "<footer>foot</footer></body>", "T\nFirst long enough paragraph here.\nSecond one é."),
    ("<body><div><div><p>One two three four five six seven.</p><script>var x='</p>';</script><p>Eight nine ten eleven twelve."
     "</div></div>", "One two three four five six seven.\nEight nine ten eleven twelve."),
])
def test_html_cases(spark, page, want):
    df = spark.createDataFrame([(1, "u", page, "x")], "page_id long, url string, html string, text string")
    (row,) = html_extraction.extract(df).collect()
    assert row["text"] == want and row["n_chars"] == len(want)


def test_html_never_breaks():
    """Random markup: no crash, no markup left of whole tags, white space as one space."""
    rng = random.Random(11)
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "<li>", "<ul>", "</ul>", "<b", ">", "\"", "'", "&amp;", "&#65;", "<!--", "-->", "<br/>",
            "<td>", "<table>", "</table>", "<script>", "</script>", " ", "\n", "word ", "many words here. ", "<a href=\"x>", "</a>", "<", "</", "<body>"]
    for _ in range(2000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        text = html_extraction.main_text(page)
        assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""
    deep = "<div>" * 3000 + "text inside " * 20 + "</div>" * 3000
    assert html_extraction.main_text(deep) == ("text inside " * 20).strip()
    open_quote = "<p>One two three four five.</p><p title=\"open>Six seven eight nine ten.</p>"
    assert html_extraction.main_text(open_quote) == "One two three four five.\nSix seven eight nine ten."


def paragraphs(low, high):
    return [f"Paragraph number {i} tells of something else that happened in the long story of the town and the river." for i in range(low, high)]


@pytest.mark.parametrize("page", [
    "<body><div>{a}</div><div>{b}</div></body>", "<body><article>{a}</article><article>{b}</article></body>",
    "<body><div><div>{a}</div><div>{b}</div></div></body>", "<body><main>{a}</main><div>{b}</div></body>", "{a}<div>{b}</div>",
    "<body><div><article>{a}</article></div><div class=x><div><article>{b}</article></div><a href=z>"
    + "linked words that go on </a><a href=z>" * 99 + "</a></div></body>",
])
@pytest.mark.parametrize("n", [3, 10, 17])
def test_html_reads_every_part_of_a_split_article(page, n):
    a, b = paragraphs(0, n), paragraphs(n, 20)
    mark = lambda x: "".join(f"<p>{t}</p>" for t in x)
    assert html_extraction.main_text(page.format(a=mark(a), b=mark(b))) == "\n".join(a + b)


def test_html_reads_loose_text_beside_the_core():
    a, b = paragraphs(0, 3), paragraphs(3, 20)
    page = "<body>" + "<br><br>".join(a) + "<div>" + "".join(f"<p>{t}</p>" for t in b) + "</div><a href=x>Home</a> | <a href=y>Up</a></body>"
    assert html_extraction.main_text(page) == " ".join(a) + "\n" + "\n".join(b)


@pytest.mark.parametrize("page", [
    "<body><div class='content has-sidebar'><article>{a}{b}</article></div></body>", "<body><div class='no-sidebar'>{a}{b}</div></body>",
    "<body><div class='layout-fixed-header'><main>{a}{b}</main></div><div class='sidebar'><p>Side side side side side.</p></div></body>",
    "<body><div id='discussion-paper'><div class='share-price-report'>{a}{b}</div></div><section id='comments'><p>{c}</p></section></body>",
    "<body><div class='notice-of-election'><article>{a}</article></div><div class='notice'><article>{b}</article></div></body>",
    "<body><div class='notice'>{a}</div><div class='notice'>{b}</div></body>",
    "<body><div>{a}{b}</div><section class='comments'><p>{c}</p><p>{c}</p><p>{c}</p></section></body>",
])
def test_html_words_of_a_class_drop_no_article(page):
    a, b = paragraphs(0, 9), paragraphs(9, 20)
    mark = lambda x: "".join(f"<p>{t}</p>" for t in x)
    page = page.format(a=mark(a), b=mark(b), c="Reader says a great deal more than the article itself does say here.")
    assert html_extraction.main_text(page) == "\n".join(a + b)


def test_html_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract(df).collect() == []


# --- packing ------------------------------------------------------------

def check_pieces(rows, docs, length):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    want = collections.Counter()
    for d, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r["offset"])
        at = 0
        for r in seq:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length
    for (d, n), pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == n * sum(c for (wd, wn, _), c in want.items() if (wd, wn) == (d, n))
    one = {(d, n): p[0]["ids_crc32"] for (d, n), p in by_doc.items() if len(p) == 1}
    assert all(want[d, n, crc] for (d, n), crc in one.items())
    assert sum(p["length"] for p in rows) == sum(n * c for (_, n, _), c in want.items())


def test_packing(spark, corpus, empty):
    rows = packing.pack(corpus, TOKENIZER, PATTERN, length=64, block=512).collect()
    check_pieces(rows, pairs_of(corpus), 64)
    assert packing.pack(empty, TOKENIZER, PATTERN).collect() == []
    rows = QUERIES["op2_packing"](spark, SF).collect()
    check_pieces(rows, pairs_of(docs_of(spark)), 2048)
    sizes = collections.Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    pad = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert pad <= 0.02 * sum(sizes.values()) + 2048


def test_packing_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(200):
        total, length = rng.randint(1, 60), rng.choice([8, 16])
        ends = sorted({*rng.sample(range(1, total + 1), rng.randint(0, min(5, total))), total})
        sentence = sorted(rng.sample(range(1, total + 1), rng.randint(0, min(9, total))))
        position, cost = packing.cut_points(np.array(ends), np.array(sentence, int), total, length)
        pay = dict(zip(position.tolist(), cost.tolist()))
        free = {length, *[s for s in (length >> 1, length >> 2, length >> 3) if s]}
        best = {0: 0.0}
        for j in position.tolist():
            best[j] = min(best[i] + (0 if j - i in free else length - (j - i)) for i in best if 0 < j - i <= length) + pay[j]
        cuts = packing.best_cuts(position, cost, length)
        got = sum((0 if j - i in free else length - (j - i)) + pay[j] for i, j in zip([0, *cuts], cuts))
        assert cuts[-1] == total and got == pytest.approx(best[total])


def test_encoder_equals_library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    ours, rng = packing.encoder(TOKENIZER, PATTERN), random.Random(2)
    assert ours.fast is not None
    kinds = ["aabb  \n\t", "the qu'll don't", "éüß ñ", "0123456", ".-=_/ ", "漢字 🙂", "<|endoftext|>", "  \x85\x1c"]
    for _ in range(1500):
        pool = rng.choice(kinds) + rng.choice(kinds)
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert ours(text).tolist() == tok.encode(text, add_special_tokens=False).ids


# --- exact dedup --------------------------------------------------------

def brute_exact(docs):
    groups = collections.defaultdict(list)
    for d, t in docs:
        groups[(t or "").translate(LOWER)].append(d)
    return groups


def test_exact_dedup(spark, corpus, empty):
    docs = pairs_of(corpus)
    groups = brute_exact(docs)
    rows = exact_dedup.dedup(corpus).collect()
    assert len(rows) == len(docs)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    kept = collections.Counter()
    for r in rows:
        g = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((d for d in g if d is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact_dedup.dedup(empty).collect() == []


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(70_000))
    whole = exact_dedup.chunk_print(data)
    for cut in (0, 1, 255, 256, 300, 69_999, 70_000):
        a, b = data[:cut], data[cut:]
        assert exact_dedup.combined(exact_dedup.chunk_print(a), exact_dedup.chunk_print(b), len(b)) == whole
    for base, prime, got in zip(exact_dedup.BASES, exact_dedup.PRIMES, whole):
        value = 0
        for x in data:
            value = (value * base + x) % prime
        assert value == got


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    """With a fingerprint that always collides, only equal texts group."""
    rows = [(i, f"text {i % 3}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = df.select("doc_id", "text")
    from pyspark.sql import functions as F
    fixed = lambda text: F.struct(F.lit(6).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("h1"),
                                  F.lit(1).cast("long").alias("h2"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    monkeypatch.setattr(exact_dedup, "prints", fixed)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(made).collect()}
    assert got == {i: (6 + i % 3, 3) for i in range(9)}


# --- line dedup ---------------------------------------------------------

def brute_lines(docs):
    first, partners, out = {}, collections.defaultdict(set), {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(line.split()) >= line_dedup.MIN_WORDS and first.setdefault(line.strip(), d) != d:
                partners[d].add(first[line.strip()])
    texts = dict(docs)
    strip = lambda t: [x.strip() for x in t.split("\n")]
    for d, t in docs:
        gone = set()
        for p in partners[d]:
            gone |= set(line_dedup.deletions(strip(texts[p]), strip(t), [len(x.split()) for x in t.split("\n")]))
        out[d] = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def test_line_dedup(spark, corpus, empty):
    docs = sorted(pairs_of(docs_of(spark)))
    got = {r["doc_id"]: r["text"] for r in QUERIES["op4_line_dedup"](spark, SF).collect()}
    assert got == brute_lines(docs)
    rows = line_dedup.dedup(corpus).collect()
    assert len(rows) == corpus.count()
    left = {r["row"]["doc_id"]: r["left"] for r in rows}
    assert left[9].count("shared line") == 6 and left[10] == "other start\nother end of ten"
    assert left[3] is None and left[4] == "" and left[6] == "two words"
    assert line_dedup.dedup(empty).collect() == []


def test_patience_is_an_alignment():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 15))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        assert line_dedup.patience(a, a) == [(i, i) for i in range(len(a))]


def brute_runs(a, b, words, least=line_dedup.MIN_WORDS):
    """Places of b in any run of lines that a holds too, of the words."""
    held = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    return {k for i in range(len(b)) for j in range(i + 1, len(b) + 1)
            if sum(words[i:j]) >= least and tuple(b[i:j]) in held for k in range(i, j)}


def test_no_common_block_is_left():
    rng = random.Random(13)
    for _ in range(1500):
        a, b = ([rng.randint(0, 7) for _ in range(rng.randint(0, 12))] for _ in range(2))
        words = [(0, 1, 1, 2, 3, 4, 5, 9)[x] for x in b]
        gone, want = set(line_dedup.deletions(a, b, words)), brute_runs(a, b, words)
        assert gone <= want and all(words[j] == 0 for j in want - gone)


def test_crossing_and_repeated_lines_go(spark):
    x, y = "a line of many words", "another line of many words"
    rows = [(1, f"{x}\n{y}"), (2, f"{y}\n{x}"), (3, f"{y}\n{x}"), (4, f"{x}\nown words of four only\n{x}")]
    got = {r["row"]["doc_id"]: r["left"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "", 4: "own words of four only"}


def test_no_line_of_an_earlier_document_is_left(spark):
    """All pairs: no line of MIN_WORDS words or more that any earlier document holds stays."""
    seen = set()
    got = {r["doc_id"]: r["text"] or "" for r in QUERIES["op4_line_dedup"](spark, "/root/testdata/sf0.01").collect()}
    for d, t in sorted(pairs_of(docs_of(spark, "/root/testdata/sf0.01"))):
        assert not seen & {x.strip() for x in got[d].split("\n") if len(x.split()) >= line_dedup.MIN_WORDS}
        seen |= {x.strip() for x in (t or "").split("\n")}


def test_runs_of_short_lines_and_unspaced_scripts_go(spark):
    verse = "\n".join(f"verse {i}" for i in range(300))
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 30
    rows = [(1, f"one\n{verse}\nend"), (2, f"two\n\n{verse}\nfin"), (3, "verse 7\nother\nthings"), (4, "甲\n" + chinese), (5, f"乙\n{chinese}\n丙"),
            (6, "a\n\nb\n\nc\n\nd e"), (7, "x\na\n\nb\n\nc\n\nd e\ny"), (8, "start\na line of many words\ntail"), (9, "a line of many words\nhead"),
            (10, "own\na line of many words\ntail\nown too")]
    got = {r["row"]["doc_id"]: r["left"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(rows) | {2: "two\n\nfin", 5: "乙\n丙", 7: "x\ny", 9: "head", 10: "own\nown too"}
    assert got == want


# --- BPE ----------------------------------------------------------------

def reference():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library():
    ranks, tk = reference()
    codec, rng = bpe.codec(RANKS, PATTERN), random.Random(4)
    kinds = ["aabbcc  \n", "the quick's", "éüß漢🙂‍", "0123456789", "....====", "aaaaaaaa", "ABcd_/-+"]
    for _ in range(2000):
        pool = rng.choice(kinds) + rng.choice(kinds)
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        ids = tk.encode_ordinary(text)
        assert codec.encode(text) == ids and "".join(codec.decode_stream(ids)) == text
    keys = list(ranks)
    for _ in range(500):
        piece = b"".join(rng.choice(keys) for _ in range(3))
        assert codec.transducer.encode(piece) == tk._encode_single_piece(piece)


def test_bounded_caches_change_nothing(monkeypatch):
    ranks, tk = reference()
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_MATCHES", 20)
    codec, rng = bpe.Codec(ranks, PATTERN), random.Random(8)
    for _ in range(200):
        text = " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 12))) for _ in range(10))
        assert codec.encode(text) == tk.encode_ordinary(text)


def test_states_stay_bounded_within_a_match(monkeypatch):
    """One long match makes no more states than are kept; those that went on in several ways outlast the others."""
    ranks, tk = reference()
    monkeypatch.setattr(bpe, "MAX_STATES", 400)
    machine, rng, most = bpe.Transducer(ranks), random.Random(5), 0
    for _ in range(3):
        piece = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=5000))
        assert machine.encode(piece) == tk._encode_single_piece(piece)
        most = max(most, len(machine.states))
        assert len(machine.moves) == len(machine.number) == len(machine.states)
    assert 200 < most <= 400
    machine.encode(b"zq")
    kept = machine.states[machine.moves[0][ord("z")][0]]
    at = machine._thin(machine.number[kept])
    assert machine.states[0] == machine.start and machine.states[at] == kept and len(machine.states) <= 202


def test_stream_decoding_holds_back_unfinished_characters():
    codec = bpe.codec(RANKS, PATTERN)
    by_byte = [codec.transducer.merges.ranks[bytes([b])] for b in "é🙂".encode()]
    assert list(codec.decode_stream(by_byte)) == ["é", "🙂"]
    assert "".join(codec.decode_stream(by_byte[:3])) == "é�"


def test_bpe_round_trip(spark, corpus, empty):
    _, tk = reference()
    want = collections.Counter()
    for d, t in pairs_of(corpus):
        ids = tk.encode_ordinary(t or "")
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[d, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.round_trip(corpus, RANKS, PATTERN).collect()) == want
    assert bpe.round_trip(empty, RANKS, PATTERN).collect() == []
    from pyspark.sql import functions as F
    back = corpus.select("text", bpe.decoded(bpe.encoded(F.col("text"), RANKS, PATTERN), RANKS, PATTERN).alias("b")).collect()
    assert all(r["b"] == (r["text"] or "") for r in back)


# --- licenses -----------------------------------------------------------

def test_license_scan(spark, empty):
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore text here."), (2, "no such thing"), (3, None),
            (4, "This work is licenced under the GNU General Public License, version 3."),
            (5, "Licensed under the Apache License, Version 2.0.\n\nMuch other prose. " * 3),
            (6, "a license to fish in the lake was sold to the man"), (7, "Licensed under CC BY-NC 4.0."), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert got[1]["licenses"] == ["MIT"] and got[4]["licenses"] == ["GPL-3.0"] and got[5]["licenses"] == ["Apache-2.0"]
    assert got[7]["licenses"] == ["CC-BY-NC-4.0"]
    assert got[2]["n_blocks"] == 0 and got[6]["licenses"] == [] and got[3]["licenses"] == []
    (f,) = got[1]["findings"]
    assert rows[0][1][f["start"]:f["end"]] == "Released under the MIT License." and f["differences"] == ""
    assert got[4]["findings"][0]["differences"]
    assert licenses.scan(empty).collect() == []


@pytest.mark.parametrize("lead", ["", "# ", " * ", "// "])
def test_license_blocks_hold_whole_notices(lead):
    """Every template lies whole in a block: hard-wrapped, in comments, and inside lines that are long."""
    import textwrap
    cue = re.compile(licenses.CUE, re.I).finditer
    prose = "much other prose of no such matter " * 200
    for text in (t for texts in licenses.TEMPLATES.values() for t in texts):
        for width in (40, 79):
            lines = textwrap.wrap("Copyright (c) 2020 Jane Doe. " + text, width - len(lead))
            page = "An opening.\n" + "".join(f"{lead}{x}\n" for x in ["", *lines, ""]) + "Other prose.\n"
            (a, b), = licenses.blocks(page, cue)
            assert " ".join(lines) in " ".join(page[a:b].replace("\n" + lead, "\n").split())
        for page in (prose + text + " " + prose, "Copyright (c) 2020 Jane Doe " + text + " " + prose):
            assert any(text in page[a:b] for a, b in licenses.blocks(page, cue))


def test_license_notice_wrapped_and_unwrapped():
    import textwrap
    step = licenses._start()
    for name in ("MIT", "GPL-3.0", "ISC"):
        text = licenses.TEMPLATES[name][1]
        for page in (textwrap.fill(text, 72), "\n".join(" * " + x for x in textwrap.wrap(text, 70)), "Copyright (c) 2020 Jane Doe " + text):
            assert step(page)[1] == [name], page


def test_every_license_wording_is_named():
    """Each template, wrapped, in comments and on a long line, gives its own licence and no other."""
    import textwrap
    step, prose = licenses._start(), "much other prose of no such matter " * 200
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for page in (text, textwrap.fill(text, 60), "\n".join(" * " + x for x in textwrap.wrap(text, 50)), prose + text + " " + prose):
                assert step(page)[1] == [name], page


@pytest.mark.parametrize("text,want", [
    ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", ["Apache-2.0", "MIT"]),
    ("a: MIT License\nb: ISC License\nc: GPL-2.0\nd: BSD 3-Clause\ne: zlib License", ["MIT", "ISC", "GPL-2.0", "BSD-3-Clause", "Zlib"]),
    ("Released under the MIT License. " + "few words " * 30 + "Licensed under CC BY 4.0. " + "few words " * 300, ["MIT", "CC-BY-4.0"]),
    ("Released under the MIT License.\n" * 3, ["MIT"] * 3),
    ("This work is licensed under the GNU General Public License, version 1.", []), ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
    ("Licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
    ("Licensed under the Apache License, Version 1.7.", []),
    ("Licensed under a Creative Commons Attribution-ShareAlike 3.7 Unported License.", []),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
     "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1"]),
    (licenses.BSD_OPENING + licenses.BSD_CLAUSES + licenses.BSD_WARRANTY, ["BSD-2-Clause"]),
])
def test_every_license_of_a_block(text, want):
    _, names, findings = licenses._start()(text)
    assert [f["license"] for f in findings] == want and names == sorted(set(want))
    assert all(a["end"] <= b["start"] for a, b in zip(findings, findings[1:]))


@pytest.mark.parametrize("text,want", [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", ["GPL-2.0-or-later"]),
    ("# spdx-license-identifier: (lgpl-2.1+ AND BSD-3-Clause) OR GPL-2.0-only WITH Classpath-exception-2.0",
     ["LGPL-2.1-or-later", "BSD-3-Clause", "GPL-2.0-only"]),
    ("SPDX-License-Identifier: LicenseRef-Own", []), ("SPDX-License-Identifier: MIT.", ["MIT"]),
    ("This work is not under the MIT License.", []), ("It was never released under the ISC License.", []),
    ("Files are no longer under GPLv3.", []), ("The code isn't BSD 3-Clause.", []),
    ("Not only the MIT License applies.", ["MIT"]), ("It was not. The MIT License applies.", ["MIT"]),
    ("See https://creativecommons.org/licenses/by-nc/3.0/ for more.", ["CC-BY-NC-3.0"]), ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
    ("Under the Artistic License 2.0", ["Artistic-2.0"]), ("under the EUPL v1.2", ["EUPL-1.2"]), ("CDDL, Version 1.0", ["CDDL-1.0"]),
    ("the GNU Free Documentation License, Version 1.3", ["GFDL-1.3"]), ("WTFPL", ["WTFPL"]), ("PostgreSQL License", ["PostgreSQL"]),
])
def test_license_expressions_and_negations(text, want):
    findings = licenses._start()(text)[2]
    assert [f["license"] for f in findings] == want
    assert all(a["end"] <= b["start"] for a, b in zip(findings, findings[1:])) and all(f["start"] < f["end"] <= len(text) for f in findings)


def test_cues_are_tried_only_where_their_letters_stand(monkeypatch):
    """The search gives what the pattern gives, and the pattern isn't run over text without the letters of a cue."""
    rng = random.Random(6)
    parts = ["licen", "licence", "ſ", "s", "c", "e", "ing", "copyright", "(c)", "©", "rights", " ", "-", "\n", "reserved", "public", "domain",
             "hereby", "granted", "redistribut", "warrant", "spdx", "creative", "commons", "cc", "by", "0", "permission", "is", "to", "a",
             "l", "gpl", "pl", "e", "m", "bsd", "eu", "wtf", "cddl", "gfdl", "İ", "ı", "é", "_", "Σ", "gplgpl", "x"]
    found = 0
    for _ in range(20_000):
        text = "".join(p if rng.random() < 0.7 else p.upper() for p in rng.choices(parts, k=rng.randint(1, 9)))
        want = [m.span() for m in re.finditer(licenses.CUE, text, re.I)]
        assert [m.span() for m in licenses.cues(text)] == want
        found += len(want)
    assert found > 5000
    monkeypatch.setattr(licenses, "_CUE", None)
    assert licenses._start()("Plain prose of other matters. " * 50)[0] == 0


def test_licenses_are_decided_by_compression(monkeypatch):
    """Without a dictionary nothing is found; with dictionaries exchanged another licence ranks first and wins the overlap."""
    # The MIT wording lacks five words of this grant, which is all of the MIT-0 wording.
    text = licenses.MIT_GRANT + "."
    known = {t.name: t for t in licenses.templates()}
    before = [t.name for _, t in licenses.rank(text)[1]]
    assert before.index("MIT-0") < before.index("ISC") and [f[0] for f in licenses.judge(text)] == ["MIT-0"]
    licenses._place.cache_clear()
    monkeypatch.setattr(known["MIT-0"], "compress", known["ISC"].compress)
    after = [t.name for _, t in licenses.rank(text)[1]]
    assert after[0] == "MIT" != before[-1] and [f[0] for f in licenses.judge(text)] == ["MIT"]
    licenses._place.cache_clear()
    for t in known.values():
        monkeypatch.setattr(t, "compress", bytes)
    assert licenses.rank(text)[1] == [] and licenses.judge(text) == []
    licenses._place.cache_clear()


def test_short_license_namings_pass_the_ranking():
    """No wording is lost in a long block of other words, wherever it stands."""
    import random
    rng = random.Random(5)
    prose = [w for texts in licenses.TEMPLATES.values() for w in texts[0].split() if w.isalpha() and w.lower() not in licenses.NAME_WORDS]
    for t in licenses.templates():
        for text in licenses.TEMPLATES[t.name]:
            words = [rng.choice(prose) for _ in range(150)]
            words.insert(rng.randrange(150), text)
            assert t.name in [x.name for _, x in licenses.rank(" ".join(words))[1]], text


def test_license_differences_equal_another_alignment():
    """Words lacked and added, against a longest common subsequence by the plain table."""
    import random
    rng, text = random.Random(3), licenses.TEMPLATES["PostgreSQL"][0]
    wanted = licenses.wording(text)
    n, confirmed = len(wanted), 0
    limit = n // 10
    for _ in range(60):
        words = text.rstrip(".").split()
        for at in sorted(rng.sample(range(8, n - 8), rng.randrange(limit + 3)), reverse=True):
            del words[at]
        for _ in range(rng.randrange(n // 5 + 3)):
            words.insert(rng.randrange(8, len(words) - 8), rng.choice(["zebra", "heron", "software"]))
        said = licenses.wording(" ".join(words))
        table = [[0] * (n + 1) for _ in range(len(said) + 1)]
        for i, a in enumerate(said):
            for j, b in enumerate(wanted):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        held = table[-1][-1]
        found = [f for f in licenses.judge(" ".join(words)) if f[0] == "PostgreSQL"]
        assert bool(found) == (n - held <= limit and len(said) - held <= n // 5), (words, found)
        if found:
            confirmed += 1
            marks = found[0][5].split()
            assert sum(x[0] == "-" for x in marks) == n - held and sum(x[0] == "+" for x in marks) == len(said) - held
            assert found[0][4] == 100 * held // n
    assert 10 < confirmed < 60


def test_license_repeated_rows_clashing_columns_and_long_texts(spark):
    import time
    rows = [(1, "MIT License", "x", 1)] * 3 + [(2, None, "MIT License", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, r int")
    got = licenses.scan(df).collect()
    assert [r["licenses"] for r in got if r["doc_id"] == 1] == [["MIT"]] * 3 and [r["n_blocks"] for r in got if r["doc_id"] == 2] == [0]
    start = time.time()
    found = licenses._start()("see the MIT License, " * 30_000 + "and GPLv2")[2]
    assert len(found) == 30_001 and found[-1]["license"] == "GPL-2.0" and time.time() - start < 30



# --- quality rules ------------------------------------------------------

def brute_rules(text):
    words = WORDS.findall(text or "")
    n, seen = len(words), collections.defaultdict(list)
    for i in range(n - 7):
        seen[tuple(words[i:i + 8])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    longest = 0
    for at in seen.values():
        for x in range(len(at)):
            for y in range(x):
                i, j, k = at[y], at[x], 0
                while j + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest = max(longest, k)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), longest, n < 20 or 100 * len(covered) > 30 * n)


def test_quality_rules(spark, corpus, empty):
    for df in (docs_of(spark), corpus.where("doc_id <> 15 or doc_id is null")):
        rows = quality_rules.rate(df.select("doc_id", "text")).collect()
        want = collections.Counter((d, *brute_rules(t)) for d, t in pairs_of(df))
        got = collections.Counter(
            (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["longest_repeat"],
             r["base_failed"]) for r in rows)
        assert got == want and not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.rate(empty).collect() == []


def test_suffix_array_and_lcp():
    rng = random.Random(6)
    for _ in range(200):
        ids = np.array([rng.randint(0, 2) for _ in range(rng.randint(1, 40))])
        levels = quality_rules.suffix_ranks(ids)
        order = np.argsort(levels[-1], kind="stable")
        assert order.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:].tolist())
        for k, got in enumerate(quality_rules.neighbour_lcp(levels, order)):
            a, b = ids[order[k]:].tolist(), ids[order[k + 1]:].tolist()
            want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got == want


# --- n-gram join --------------------------------------------------------

def brute_join(docs, words, pct):
    sets = []
    for _, t in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return collections.Counter((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("words,pct", [(3, 90), (5, 80)])
def test_ngram_join(spark, corpus, empty, words, pct):
    for df in (docs_of(spark), corpus):
        got = ngram_join.join_components(df, words, pct).collect()
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_join(pairs_of(df), words, pct)
    assert ngram_join.join_components(empty, words, pct).collect() == []


def test_ngram_join_of_a_large_cluster_without_a_centre(spark, monkeypatch):
    """A chain of small changes, and groups so small that links cross them."""
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 300)
    monkeypatch.setattr(ngram_join, "GROUP_QUERIES", 3)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        if i % 40 == 0:
            words = [f"v{i}x{k}" for k in range(100)]
        words = list(words)
        words[rng.randrange(100)] = f"n{rng.randrange(6)}"
        rows.append((500 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.join_components(df, 3, 90).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_join(rows, 3, 90)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(200, 100), (100, 150), (7, 7)]
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 200: 100, 100: 100, 150: 100}


# --- secrets ------------------------------------------------------------

def brute_spans(text):
    kinds = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 0),
             (re.compile(r"AKIA[A-Z0-9]+"), 1), (re.compile(r"[0-9a-f]+"), 2)]
    found = []
    for rx, k in kinds:
        for m in rx.finditer(text or ""):
            size = len(m[2]) if k == 0 else len(m[0])
            if size >= (6, 20, 24)[k]:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_scan(spark, corpus, empty):
    for df in (docs_of(spark), corpus):
        rows = secrets.scan(df.select("doc_id", "text", "lang"), RANKS, PATTERN).collect()
        want = collections.Counter((d, hashlib.sha256(brute_spans(t).encode()).hexdigest()) for d, t in pairs_of(df))
        assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in rows) == want
        for r in rows:
            base = ",".join(x for x in r["spans"].split(",") if x and not x.startswith("random"))
            assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
    assert secrets.scan(empty, RANKS, PATTERN).collect() == []


@pytest.mark.parametrize("text,found", [
    ("see q8Zt3vXw9KpL2mNb7RcY5dHf here", True), ("a readable_name_of_2_parts_here", False),
    ("id 123e4567-e89b-12d3-a456-426614174000 ok", False), ("D41D8CD98F00B204E9800998ECF8427E", False),
    ("20240101202401012024", False), ("einenlichkeitverschiebungen", False), ("getUserNameFromTable42", False),
    ("x9!" * 10, False),
])
def test_random_strings(text, found):
    assert any(k == 3 for _, k, _ in secrets.finder(RANKS, PATTERN)(text)) is found


@pytest.mark.parametrize("alphabet", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                      "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
def test_random_keys_are_found_by_characters_per_token(alphabet):
    """No expression comes before the vocabulary: every key of fewer than 2 characters a token is found, and nearly all are such."""
    rng, find = random.Random(17), secrets.finder(RANKS, PATTERN)
    encode = secrets._encoder(RANKS, PATTERN)
    for n in (20, 32):
        keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(400)]
        keys = [k for k in keys if not re.search("[0-9a-f]{24}", k)]
        efficient = sum(len(k) >= 2 * len(encode(k)) for k in keys)
        assert sum(not find(f"see {k} here") for k in keys) == efficient <= 0.03 * len(keys)


@pytest.mark.parametrize("name", ["MAX_RETRY_COUNT_2_TIMES", "KUBERNETES_SERVICE_PORT_443", "content_type_id_2024_v2", "-" * 30, "usr/local/lib/python3/site-packages"])
def test_names_are_no_secrets(name):
    assert secrets.finder(RANKS, PATTERN)(name) == []


# --- quality classifier -------------------------------------------------

def test_classifier(spark, corpus, empty):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_quality_classifier"](spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    labels = spark.createDataFrame([(0, 1), (2, 0), (99, 1), (None, 1), (6, None)], "doc_id long, quality int")
    assert len(quality_classifier.classify(corpus, labels).collect()) == corpus.count()
    none = quality_classifier.classify(corpus, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_classifier.classify(empty, labels).collect() == []


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(k, 1 + k, (400, len(quality_classifier.STATISTICS))) for k in (0, 1)]
    n = np.array([400.0, 400.0])
    model = quality_classifier.discriminant(n, np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    assert (model.scores(x[1]) > 0.5).mean() > 0.95 and (model.scores(x[0]) < 0.5).mean() > 0.95


ARTICLE_NAMES = ["discussion", "related-work", "header-files", "social-impact", "notice-period", "share-price", "sidebars", "comments-on-the-text", "menus",
                 "advert-history", "footer-notes"]


@pytest.mark.parametrize("name", ARTICLE_NAMES)
def test_html_ids_of_headings_and_sections_stay(name):
    a = paragraphs(0, 12)
    mark = lambda x: "".join(f"<p>{t}</p>" for t in x)
    head = f"<main>{mark(a[:4])}<h2 id='{name}'>A heading of its own</h2>{mark(a[4:])}</main>"
    assert html_extraction.main_text(f"<body>{head}</body>") == "\n".join([*a[:4], "A heading of its own", *a[4:]])
    if name in ("sidebars", "menus"):
        return  # a container of such a name is one
    for wrap in ("article", "main", "div"):
        parts = "".join(f"<section id='{n}'><h2>{n}</h2>{mark(a[3 * i:3 * i + 3])}</section>" for i, n in enumerate(("introduction", "methods", name, "conclusion")))
        got = html_extraction.main_text(f"<body><{wrap}>{parts}</{wrap}></body>")
        assert [t for t in a if t not in got.split("\n")] == [], (wrap, name)


def test_html_boxes_of_the_article_stay_and_what_lies_beside_goes():
    a = paragraphs(0, 12)
    mark = lambda x: "".join(f"<p>{t}</p>" for t in x)
    box = "<div class='alert alert-info'><p>Before the tests are run, the whole library has to be built once with all of its parts in place.</p></div>"
    said = "Before the tests are run, the whole library has to be built once with all of its parts in place."
    advert = "<div class='ad-slot'><p>Buy the finest boots of the whole town today and get a second pair of them for nothing at all.</p></div>"
    comments = "<section class='comments'><div class='comment'><p>I have read this article and I do not agree with a single word of it, I must say.</p></div></section>"
    notice = "<div id='cookie-notice'><p>This page keeps small files on your computer in order to know you again when you come back to it.</p></div>"
    for page in (f"<body><article>{mark(a[:6])}{box}{advert}{mark(a[6:])}</article>{comments}{notice}</body>",
                 f"<body><main><article>{mark(a[:6])}{box}{mark(a[6:])}{comments}</article></main>{notice}</body>",
                 f"<body>{notice}<div class='content'>{mark(a[:6])}{box}{mark(a[6:])}</div><div class='reader-comments'>{comments}</div></body>"):
        assert html_extraction.main_text(page) == "\n".join([*a[:6], said, *a[6:]])
