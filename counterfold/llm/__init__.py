"""Operators for preparing training text: each is one module, Spark jobs throughout.

Nothing else in the library imports this package.
"""
