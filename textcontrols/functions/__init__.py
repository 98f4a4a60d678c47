"""Column expressions: all JVM-side, no Python UDFs."""

from textcontrols.functions.text import normalize_text, word_count, strip_text
from textcontrols.functions.recode import (
    lenient_double, lenient_bool, null_tokens_to_null, reverse_score, factor_level,
    factor_position, recode_map, role_of_condition,
)
from textcontrols.functions.stats import t_quantile

__all__ = [
    "normalize_text", "word_count", "strip_text", "lenient_double", "lenient_bool",
    "null_tokens_to_null", "reverse_score", "factor_level", "factor_position", "recode_map",
    "role_of_condition", "t_quantile",
]
