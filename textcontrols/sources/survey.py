"""Survey exports: raw CSV with optional metadata rows, and the analysis CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcontrols.functions.recode import PANDAS_NULL_TOKENS, null_tokens_to_null
from textcontrols.sources.csv_ranges import read_csv_ranges


def null_tokens(df: DataFrame, tokens: Sequence[str] = PANDAS_NULL_TOKENS,
                cols: Sequence[str] | None = None) -> DataFrame:
    """Turn every token of ``tokens`` into null in the string columns ``cols``."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields
                                                if f.dataType.simpleString() == "string"]
    return df.select(*[null_tokens_to_null(c, tokens).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def read_survey_csv(spark: SparkSession, path: str, date_col: str = "StartDate",
                    apply_null_tokens: bool = True) -> DataFrame:
    """Raw survey export: header row, all columns as text, metadata rows removed.

    Exports may carry two metadata rows under the header (question texts and
    import ids).  Rows have no position in a distributed read, so the two rows
    are recognised by content: their ``date_col`` holds "Date" or "ImportId",
    which a real timestamp never does.  Quoted fields may span lines; a large
    file is read by many tasks all the same (``csv_ranges``).
    """
    df = read_csv_ranges(spark, path)
    if date_col in df.columns:
        df = df.where(~F.coalesce(F.col(date_col).rlike("Date|ImportId"), F.lit(False)))
    if apply_null_tokens:
        df = null_tokens(df)
    return df


def read_analysis_csv(spark: SparkSession, path: str) -> DataFrame:
    """Analysis CSV with R reader semantics: only "NA" is missing, an empty field is "".

    Spark's CSV reader turns an unquoted empty field into null, so the file is
    read with a null marker that never occurs; every null then came from an
    empty field and becomes "", and the literal "NA" becomes null.
    """
    df = read_csv_ranges(spark, path, nullValue="\u0000")
    return df.select(*[F.when(F.col(c).isNull(), F.lit("")).when(F.col(c) == "NA", F.lit(None))
                       .otherwise(F.col(c)).alias(c) for c in df.columns])
