"""Tessellon: retrieval, text and knowledge-graph analytics as Spark DataFrame plans."""
