"""Readers and writers: Parquet tables, survey CSV exports, JSON metadata, snapshots."""

from textcontrols.sources.tables import TABLES, load_table, register_tables
from textcontrols.sources.survey import read_survey_csv, read_analysis_csv, null_tokens
from textcontrols.sources.metadata import read_json_metadata
from textcontrols.sources.snapshot import materialize

__all__ = [
    "TABLES", "load_table", "register_tables", "read_survey_csv", "read_analysis_csv",
    "null_tokens", "read_json_metadata", "materialize",
]
