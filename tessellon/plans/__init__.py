"""Whole queries, with their SQL twins."""
