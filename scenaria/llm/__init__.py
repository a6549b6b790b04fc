"""Operators of a training-data pipeline over documents, pages and vectors.

Nothing outside this subpackage imports it.
"""
