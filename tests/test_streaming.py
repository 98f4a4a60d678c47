"""Streaming: micro-batch matching equals the batch result."""

import tempfile

from pyspark.sql import functions as F

from textcontrols.operators.match import match_column
from textcontrols.plans.frames import benchmark_lookup
from textcontrols.streaming import start_match_stream, stream_text_features

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lookup = benchmark_lookup(spark, SF)
    full = spark.read.parquet(f"{SF}/documents.parquet").schema
    stream = (spark.readStream.schema(full).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "documents.parquet").parquet(SF).select("doc_id", "text"))
    assert stream.isStreaming and stream_text_features(stream, "text").isStreaming
    out = tempfile.mkdtemp(prefix="tc-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="tc-stream-ckpt-")
    q = start_match_stream(stream, "text", lookup, out, ckpt)
    q.awaitTermination(300)
    got = {(r.doc_id, r.pos, r.word_count) for r in spark.read.parquet(out).collect()}
    want = {(r.doc_id, r.pos, r.word_count) for r in
            match_column(stream_text_features(docs, "text"), "text", lookup).collect()}
    assert got == want and len(got) == docs.count()


def test_recodes_run_on_event_stream(spark):
    from textcontrols.plans.frames import survey_columns
    from textcontrols.plans.q_recode import analysis_columns

    ev = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    typed = analysis_columns(survey_columns(stream)).select("event_id", "Pref", "condition", "matched")
    assert typed.isStreaming
    q = typed.writeStream.format("memory").queryName("tc_events_typed").outputMode("append") \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM tc_events_typed").collect())
    want = sorted(tuple(r) for r in analysis_columns(survey_columns(ev)).select(
        "event_id", "Pref", "condition", "matched").collect())
    assert got == want and len(got) == ev.count()


def test_pair_enrichment_per_micro_batch(spark):
    from textcontrols.operators.match import enrich_pairs
    from textcontrols.streaming import start_batch_stream

    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    lookup = benchmark_lookup(spark, SF)
    stream = spark.readStream.schema(conv.schema).option("pathGlobFilter", "conversations.parquet").parquet(SF)
    pairs = stream.select("conv_id", "turn", F.col("text").alias("Text_Base"), F.col("text").alias("Text_Comparison"))
    out = tempfile.mkdtemp(prefix="tc-stream-out-")
    q = start_batch_stream(pairs, lambda b: enrich_pairs(b, "Text_Base", "Text_Comparison", lookup, 64), out,
                           tempfile.mkdtemp(prefix="tc-stream-ckpt-"))
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == conv.count() and got.where("wc_diff != 0").count() == 0
