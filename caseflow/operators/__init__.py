"""DataFrame -> DataFrame operators, grouped by layer."""
