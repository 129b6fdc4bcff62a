"""Column-level helpers: every function maps Columns to Columns."""
