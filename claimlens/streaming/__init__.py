"""Structured Streaming forms of detection, summaries, de-duplication and validation."""
