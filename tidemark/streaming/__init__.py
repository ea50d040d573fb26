"""Structured Streaming: replay, recording with end-of-input flush, streaming verdicts."""
