"""Part of the graph engine: plans."""
