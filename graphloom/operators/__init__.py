"""Operators: DataFrames in, DataFrames out, keyed by snapshot_id."""
