"""Structured Streaming forms: ordered release, checkpoints, sinks."""
