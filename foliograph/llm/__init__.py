"""Operators for large-scale training-data preparation.

Nothing outside this package imports it, so the package can be removed without touching the rest of the library.
"""
