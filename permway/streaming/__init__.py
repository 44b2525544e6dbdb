"""Incremental folding of a growing log."""
