"""Incremental acceptance of results."""
