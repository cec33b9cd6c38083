"""Part of the graph engine: sources."""
