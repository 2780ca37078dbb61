"""Log adapters, experiment tables and sinks."""
