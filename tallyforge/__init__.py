"""Spark-first analytics over accounting documents and text corpora."""
