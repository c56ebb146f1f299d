"""Composed pipelines and models."""
