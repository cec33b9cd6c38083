"""Property-graph analytics over source trees and tables, on PySpark DataFrames."""

__version__ = "0.1.0"
