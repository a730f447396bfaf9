"""Operators for large text corpora, each a DataFrame-to-DataFrame function.

Nothing else in the library imports this subpackage.
"""
