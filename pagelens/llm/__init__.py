"""Operators for preparing large training corpora, each a Spark job.

Nothing else in the library imports this package.
"""
