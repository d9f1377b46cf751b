"""Concept-graph analytics as Spark plans."""
