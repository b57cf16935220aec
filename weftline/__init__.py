"""Weftline: retrieval, knowledge-graph and training-data analytics as plain Spark plans."""
