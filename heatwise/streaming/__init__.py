"""Structured Streaming: continuous scoring and per-file labelling."""

from heatwise.streaming.streams import stream_label, stream_score  # noqa: F401
