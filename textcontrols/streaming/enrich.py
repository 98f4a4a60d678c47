"""Text enrichment of a streaming DataFrame.

Normalisation and word counts are row-wise column expressions, so they apply
to a streaming DataFrame unchanged.  Ordered matching needs a first-match
minimum per text, so it runs per micro-batch with ``foreachBatch`` using the
batch operator against a static lookup.  Each epoch writes its own folder in
overwrite mode: a replayed epoch replaces its output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textcontrols.functions.text import normalize_text, word_count
from textcontrols.operators.match import match_column


def stream_text_features(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``normalized`` and ``word_count`` (works on batch and streaming frames)."""
    return df.withColumn("normalized", normalize_text(text_col)).withColumn("word_count", word_count(text_col))


def start_batch_stream(stream: DataFrame, transform, out_path: str, checkpoint_location: str,
                       available_now: bool = True) -> StreamingQuery:
    """Apply a batch operator ``transform(df) -> df`` to every micro-batch; one folder per epoch.

    Overwrite mode per epoch folder makes a replayed epoch replace its output,
    so the sink is idempotent under retries and executor loss.
    """

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        transform(batch).withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite") \
            .parquet(f"{out_path}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_match_stream(stream: DataFrame, text_col: str, lookup: DataFrame, out_path: str,
                       checkpoint_location: str, available_now: bool = True,
                       empty_matches: bool = True) -> StreamingQuery:
    """Match every micro-batch to the lookup and write it under ``out_path/epoch=<id>``."""
    return start_batch_stream(
        stream, lambda b: match_column(stream_text_features(b, text_col), text_col, lookup, empty_matches),
        out_path, checkpoint_location, available_now)
