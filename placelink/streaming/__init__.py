"""Incremental processing of document streams."""
