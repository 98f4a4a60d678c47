"""Registered queries over the driver tables and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``.
Each query reads whole driver tables (or frames Spark derives from them).
"""

from textcontrols.plans.registry import QUERIES, ORACLES
from textcontrols.plans import (  # noqa: F401  (registration side effects)
    q_text, q_match, q_recode, q_catalog, q_describe, q_models, q_embed, q_validate, q_sources, q_chain,
)

__all__ = ["QUERIES", "ORACLES"]
