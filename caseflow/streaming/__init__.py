"""Structured Streaming form of the directly-follows counter (an extension:
the same operator as B1, maintained incrementally)."""
