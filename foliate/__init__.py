"""Spark jobs over corpora of technical documentation."""
