"""Operators for preparing training data (optional subpackage).

Nothing else in the library imports this package.
"""
