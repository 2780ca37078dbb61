"""Training-data operators (one module per operator) and their queries.

Nothing else in the library imports this package; ``queries.py`` holds the
registered queries and their SQL."""
