"""Column-expression helpers and ordered-window utilities."""
