"""Part of the graph engine: streaming."""
