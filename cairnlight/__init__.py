"""Cairnlight: knowledge indexing, hybrid retrieval and reconciliation as Spark DataFrame plans."""
