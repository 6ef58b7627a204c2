"""Operators of a training-data pipeline over documents, vectors and web pages.

Nothing else in the library imports this subpackage.
"""
