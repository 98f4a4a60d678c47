"""Secret scans by token efficiency.

Fixed patterns find assigned values, access keys and long hexadecimal strings.
The method adds strings that a byte-level BPE vocabulary needs unusually many
tokens for: text that people write is in the vocabulary, random text is not.
Known digest forms and identifiers are excluded first.  What it tests are the
parts of at least MIN_RUN characters of unbroken runs that lie outside the fixed patterns'
spans; a run is cut and judged in one pass, so the time is linear in its
length.

Defined results: a null or empty text has no span; texts of any length are
scanned whole; repeated rows get equal results; an empty table gives an empty
table; other columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textcontrols.llm.work import require, ship, sliced, text_udf

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGNED = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the greedy run AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # the greedy run [0-9a-f]+ of 24 characters or more
#: Candidates of the method: unbroken runs, and parts of them, of this many characters or more.
MIN_RUN = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
#: Fewer characters for each token than this is random; prose and names have 3 to 5.
MAX_CHARS_PER_TOKEN = 2.0
#: Hexadecimal digests by length (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and UUIDs.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: The cut of an identifier: letters (by capitals), digits, separators.
PIECE = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+|[+/_=-]+"
#: Letters that a readable piece has at least, with the characters for each token in lower case; digits at most.
PIECE_LETTERS, NAME_CHARS_PER_TOKEN, PIECE_DIGITS = 3, 2.5, 8
PLACEHOLDER = "[SECRET]"

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def finder(path: str, pattern: str):
    """text -> (start, kind number, end) in order of start, then kind; code points, end exclusive."""
    assign = re.compile(ASSIGN, re.I | re.A).finditer
    access, hexes, runs = (re.compile(p).finditer for p in (ACCESS, HEX, CANDIDATE))
    uuid = re.compile(UUID).fullmatch
    pieces = re.compile(PIECE).finditer
    is_hex = re.compile(r"[0-9a-fA-F]+").fullmatch
    encode = _encoder(path, pattern)

    def readable(piece: str) -> bool:
        if piece[0].isdigit():
            return len(piece) <= PIECE_DIGITS
        if not piece[0].isalpha():
            return True
        return len(piece) >= PIECE_LETTERS and len(piece) >= NAME_CHARS_PER_TOKEN * len(encode(piece.lower()))

    def random(s: str) -> bool:
        if s.isdigit() or not any(map(str.isalnum, s)) or len(s) >= MAX_CHARS_PER_TOKEN * len(encode(s)):
            return False
        return not (uuid(s) or len(s) in DIGEST_LENGTHS and is_hex(s) or all(readable(m[0]) for m in pieces(s)))

    def parts(text: str, base: list[tuple[int, int]]):
        """Parts of the runs outside the base spans, both in order of their starts."""
        at = 0
        for m in runs(text):
            start, end = m.span()
            while at < len(base) and base[at][1] <= start:
                at += 1
            k = at
            while k < len(base) and base[k][0] < end:
                if base[k][0] > start:
                    yield start, base[k][0]
                start = max(start, base[k][1])
                k += 1
            at = max(at, k - 1)
            if start < end:
                yield start, end

    def find(text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in assign(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in access(text)]
        found += [(m.start(), 2, m.end()) for m in hexes(text)]
        found += [(a, 3, b) for a, b in parts(text, joined((a, b) for a, _, b in found)) if b - a >= MIN_RUN and random(text[a:b])]
        return sorted(found)

    return find


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a < found[-1][1]:
            found[-1] = found[-1][0], max(b, found[-1][1])
        else:
            found.append((a, b))
    return found


def _start(path: str, pattern: str):
    find = finder(path, pattern)

    def said(spans) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def step(text: str) -> tuple:
        spans = find(text)
        n = [sum(k == i for _, k, _ in spans) for i in range(4)]
        base = said(s for s in spans if s[1] < 3)
        return n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), said(spans), n[3]

    return step


def scan(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep`` and those of SCHEMA."""
    require(docs, text, *keep)
    call = text_udf(lambda: _start(ranks, pattern), SCHEMA)
    return docs.select(F.struct(*keep).alias("k"), call(F.col(text)).alias("r")).select("k.*", "r.*")


def masked(text: Column, ranks: str, pattern: str) -> Column:
    """The text with every span (overlapping ones joined) replaced by a placeholder; null stays null."""
    ship()

    @F.arrow_udf(StringType())
    def call(texts: pa.Array) -> pa.Array:
        find = finder(ranks, pattern)

        def mask(t: str | None) -> str | None:
            if not t or not (spans := find(t)):
                return t
            parts, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    parts += [t[at:a], PLACEHOLDER]
                at = max(at, b)
            return "".join([*parts, t[at:]])

        return pa.array([mask(t) for t in sliced(texts)], pa.string())

    return call(text)
