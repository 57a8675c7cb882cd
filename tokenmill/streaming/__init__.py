"""Incremental tokenization."""
