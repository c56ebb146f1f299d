"""Streaming forms of the tumbling operators."""
