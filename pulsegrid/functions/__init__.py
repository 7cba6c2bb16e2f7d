"""Column expressions and grouped helpers."""
