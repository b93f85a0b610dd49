"""Relational, combinatorial and evidence operators as Spark DataFrame plans."""
