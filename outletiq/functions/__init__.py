"""Column expressions, period arithmetic, parsers and join helpers."""
