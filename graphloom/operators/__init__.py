"""Part of the graph engine: operators."""
