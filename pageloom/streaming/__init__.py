"""Batches of file events, from tables and from streams."""
