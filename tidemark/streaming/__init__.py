"""Structured Streaming twins of batch reports."""
