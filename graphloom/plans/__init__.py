"""Compositions of operators: analyses, reports, queries, the command line."""
