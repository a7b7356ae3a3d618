"""Column expressions of interferometry."""
