"""Structured Streaming forms of the label-free operators."""
