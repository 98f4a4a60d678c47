"""SQL text fragments for the DuckDB oracles (same semantics as the Spark columns)."""

from textcontrols.functions.text import NORMALIZE_DELETIONS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(col: str) -> str:
    """normalize_text in DuckDB SQL (RE2 blank class; driver texts hold ASCII blanks only)."""
    out = f"lower(regexp_replace(coalesce({col}, ''), '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g'))"
    for s in NORMALIZE_DELETIONS:
        out = f"replace({out}, {_q(s)}, '')"
    return out


def wc(col: str) -> str:
    """word_count in DuckDB SQL."""
    return f"CAST(coalesce(len(regexp_extract_all({col}, '[^\\s\\x1c-\\x1f]+')), 0) AS BIGINT)"
