"""Structured Streaming modes of the batch operators."""
