"""Structured Streaming forms of windowing and scoring."""
