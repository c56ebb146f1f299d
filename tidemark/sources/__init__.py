"""Readers and writers. Everything goes through Spark's file systems; no local paths are opened."""
