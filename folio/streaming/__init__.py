"""Structured Streaming twins of the job operators."""
