"""Operators on DataFrames: rows, joins, ranks, selection, sampling, scoring."""
