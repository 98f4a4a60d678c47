"""Quality rules by suffix-array repetition.

For each text the suffix array over its words is built by prefix doubling; the
longest-common-prefix values of neighbouring suffixes give the intervals of
maximal repeated word strings.  The union of their spans and the longest of
them are limited.

Defined results: a null or empty text has no word and fails (too few words);
a text of any length is read whole; repeated rows and ties get equal results;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcontrols.llm.work import WHITE, WORD_PATTERN, require, text_udf

#: Words of the shortest repeat that counts.
MIN_REPEAT = 8
MIN_WORDS = 20
#: Shares of the words that the base rule and the method allow, in hundredths.
MAX_REPEAT_PCT = 30
MAX_COVERED_CHARS_PCT = 30
MAX_LONGEST_PCT = 15
SYMBOLS = "#*$%&|<>"

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_repeats long, longest_repeat long, covered_chars long, base_failed boolean, kept boolean")


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... items, until no two are equal.

    Level k orders suffixes by 2**k items; a suffix that ends earlier comes
    first.  The last level orders them whole: its argsort is the suffix array.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank], 1
    while width < n:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:]
        found, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        width *= 2
        levels.append(rank)
        if len(found) == n:
            break
    return levels


def neighbour_lcp(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Items that each suffix shares with the one before it in the suffix array, by binary lifting."""
    n = len(order)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        fits = (np.maximum(a, b) + width) <= n
        same = fits & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        for x in (a, b, lcp):
            x[same] += width
    return lcp


def repeats(ids: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, int, int]:
    """(covered: bool for each item, number of maximal repeated strings, items of the longest).

    A string counts when it has ``least`` items or more and occurs twice or
    more; one interval of equal common prefixes is one maximal string.
    """
    n = len(ids)
    covered = np.zeros(n, bool)
    if n <= least:
        return covered, 0, 0
    levels = suffix_ranks(ids)
    if (1 << (len(levels) - 1)) <= least and len(np.unique(levels[-1])) == n:
        return covered, 0, 0
    order = np.argsort(levels[-1], kind="stable")
    lcp = neighbour_lcp(levels, order)
    reach = np.zeros(n, np.int64)
    reach[order[1:]] = lcp
    np.maximum.at(reach, order[:-1], lcp)
    starts = np.flatnonzero(reach >= least)
    if not len(starts):
        return covered, 0, 0
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + reach[starts], -1)
    covered = np.cumsum(step[:-1]) > 0
    return covered, intervals(lcp, least), int(reach.max())


def intervals(lcp: np.ndarray, least: int) -> int:
    """Intervals of the suffix array with a common prefix of ``least`` items or more: the maximal repeated strings."""
    count, open_lengths = 0, []
    for length in lcp.tolist():
        while open_lengths and open_lengths[-1] > length:
            open_lengths.pop()
        if length >= least and (not open_lengths or open_lengths[-1] < length):
            open_lengths.append(length)
            count += 1
    return count


def _start():
    find, word = re.compile(WORD_PATTERN).findall, re.compile(WORD_PATTERN).search

    def step(text: str) -> tuple:
        words = find(text)
        n = len(words)
        chars = len(text) - sum(map(text.count, WHITE))
        symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if word(x)]
        codes: dict[str, int] = {}
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
        covered, count, longest = repeats(ids)
        repeated = int(covered.sum())
        covered_chars = int(np.fromiter(map(len, words), np.int64, n)[covered].sum()) if repeated else 0
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PCT * n
        kept = not failed and 100 * covered_chars <= MAX_COVERED_CHARS_PCT * chars and 100 * longest <= MAX_LONGEST_PCT * n
        return n, chars, symbols, len(lines) - len(set(lines)), repeated, count, longest, covered_chars, failed, kept

    return step


def repetition(text: Column | str) -> Column:
    """Struct of the counts and the verdict for one text column."""
    return text_udf(_start, SCHEMA)(text)


def rate(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep`` and those of SCHEMA."""
    require(docs, text, *keep)
    rated = docs.select(F.struct(*keep).alias("k"), repetition(F.col(text)).alias("r"))
    return rated.select("k.*", "r.*")
