"""Relational operators: aggregations, joins, graph and matrix steps, top-k."""
