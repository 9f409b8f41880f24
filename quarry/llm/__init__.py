"""Operators of a training-data pipeline: tokens, packing, quality, duplicates, secrets, vectors.

Nothing else in the library imports this package.  Every operator is a function
``DataFrame(s) -> DataFrame``; ``suite`` holds the registered queries.
"""
