"""Column to column helpers."""
