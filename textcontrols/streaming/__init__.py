"""Streaming: stateless text features on a stream, and lookup matching per micro-batch."""

from textcontrols.streaming.enrich import start_batch_stream, start_match_stream, stream_text_features

__all__ = ["stream_text_features", "start_match_stream", "start_batch_stream"]
