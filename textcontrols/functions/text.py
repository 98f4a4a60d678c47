"""Text normalisation and word counts as built-in column expressions.

Python's ``str.strip``/``str.split`` treat Unicode white space plus the four
separators U+001C..U+001F as blanks.  Java's ``(?U)\\s`` covers the Unicode
white space, so the separators are added to the class explicitly.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's white-space set (str.isspace), derived by rule over all code points.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())
# Blank class equal to Python's str.isspace(): Unicode White_Space + U+001C..U+001F.
BLANK_CLASS = "[\\s\\x1c-\\x1f]"
_STRIP_RE = "(?U)\\A" + BLANK_CLASS + "+|" + BLANK_CLASS + "+\\z"
_WORD_RE = "(?U)[^\\s\\x1c-\\x1f]+"

# The substrings deleted after lower-casing, applied one after the
# other in exactly this order (trade mark, registered, copyright, then four
# encoding-damage forms of the trade-mark sign / apostrophe).
NORMALIZE_DELETIONS = (
    "™",
    "®",
    "©",
    "‚ñ¢",
    "‚äó",
    "â„¢",
    "â€™",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Remove leading and trailing blanks (Python ``str.strip`` semantics).

    ``trim`` with an explicit character set only looks at the two ends of the
    string (a regular expression would scan every blank of the text).
    """
    return F.trim(_col(c), F.lit(PY_WHITESPACE))


def normalize_text(c, deletions=NORMALIZE_DELETIONS) -> Column:
    """null -> '', strip, lower-case, then delete each substring in order.

    The deletions are sequential ``replace`` calls, not one alternation: a
    deletion can create (or destroy) an occurrence of a later pattern, and the
    order decides the result.
    """
    out = F.lower(strip_text(F.coalesce(_col(c), F.lit(""))))
    for s in deletions:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def word_count(c) -> Column:
    """Number of blank-separated tokens; null and blank text count 0 (long)."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(_WORD_RE)), F.lit(0)).cast("long")
