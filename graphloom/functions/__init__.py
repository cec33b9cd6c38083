"""Part of the graph engine: functions."""
