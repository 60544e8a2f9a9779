"""Column expressions (rules, hashes) and distributed ordering helpers."""
