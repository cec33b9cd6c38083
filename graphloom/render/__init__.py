"""Part of the graph engine: render."""
