"""Stateful twins of the batch operators, for Structured Streaming."""

from eventide.streaming.stateful import debounced_left_stream, latest_left_stream, running_stream, trailing_stream
from eventide.streaming.watermark import backfill_then_live, with_lateness

__all__ = ["backfill_then_live", "debounced_left_stream", "latest_left_stream", "running_stream", "trailing_stream", "with_lateness"]
