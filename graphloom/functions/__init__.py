"""Column expressions and pure functions that operators share."""
