"""Part of the query engine."""
