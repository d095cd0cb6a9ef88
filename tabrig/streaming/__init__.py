"""Structured Streaming entry points (scoring new rows with a saved pipeline)."""

from .scoring import score_stream, start_scoring

__all__ = ["score_stream", "start_scoring"]
