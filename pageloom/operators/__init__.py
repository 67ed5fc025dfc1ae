"""Operators on files, indexes and queries."""
