"""Recodes, lenient casts and factors as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that a pandas CSV reader turns into a missing value.
PANDAS_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# The only token R's read.csv turns into NA for character columns.
R_NULL_TOKENS = ("NA",)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens_to_null(c, tokens: Sequence[str] = R_NULL_TOKENS) -> Column:
    """Map any of ``tokens`` to null, keep other strings unchanged."""
    c = _col(c)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


# What R's as.logical reads as true and as false.
R_TRUE = ("T", "TRUE", "True", "true")
R_FALSE = ("F", "FALSE", "False", "false")
# Fixed value: decimal and exponent notation, infinity and not-a-number as R's as.numeric reads them.
R_NUMBER = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|Inf|NaN|(?i:infinity))$"


def lenient_double(c, tokens: Sequence[str] = R_NULL_TOKENS) -> Column:
    """``as.numeric``: trimmed text to double, anything that isn't a number -> null.

    The pattern keeps out what Java's parser alone takes (``5d``, ``5f``);
    ``try_cast`` keeps ANSI mode from raising.
    """
    s = F.trim(null_tokens_to_null(_col(c).cast("string"), tokens))
    return F.when(s.rlike(R_NUMBER), s.try_cast("double"))


def lenient_bool(c) -> Column:
    """``as.logical``: the four spellings of true and of false, untrimmed; anything else -> null."""
    s = _col(c).cast("string")
    return F.when(s.isin(*R_TRUE), True).when(s.isin(*R_FALSE), False)


def reverse_score(flag, rating, scale_max: int = 7, centre: int = 4) -> Column:
    """Preference on a centred scale: ``flag==1 ? r-centre : (scale_max+1-r)-centre``.

    A null flag or rating gives null (``otherwise`` alone would turn a null flag
    into the reversed branch).
    """
    flag, rating = _col(flag), _col(rating)
    return (
        F.when(flag.isNull() | rating.isNull(), F.lit(None).cast("double"))
        .when(flag == 1, rating - centre)
        .otherwise((scale_max + 1) - rating - centre)
        .cast("double")
    )


def factor_level(c, levels: Sequence[str]) -> Column:
    """Value if it is one of ``levels``, else null; the row itself is kept."""
    c = _col(c)
    return F.when(c.isin(list(levels)), c)


def factor_position(c, levels: Sequence[str]) -> Column:
    """1-based position of the value in ``levels``; null outside the levels."""
    c = _col(c)
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), c)
    return F.when(pos > 0, pos.cast("long"))


def recode_map(c, mapping: Mapping[str, str]) -> Column:
    """Map values by a small fixed dictionary; unmapped values -> null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, _col(c)) if mapping else F.lit(None).cast("string")


def role_of_condition(c, roles: Sequence[str] = ("Base", "Short", "Long")) -> Column:
    """Role part of a condition name ("ShortFT" -> "Short"); null when none."""
    r = F.regexp_extract(_col(c), "^(" + "|".join(roles) + ")", 1)
    return F.when(r != "", r)


def control_columns(columns: Sequence[str], prefix: str = "INTN") -> list[str]:
    """Columns named ``{prefix}<number>`` in numeric order (INTN10 after INTN9)."""
    pat = re.compile("^" + re.escape(prefix) + "([0-9]+)$")
    hits = [(int(m.group(1)), c) for c in columns if (m := pat.match(c))]
    return [c for _, c in sorted(hits)]
