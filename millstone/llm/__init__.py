"""Operators of a training-data pipeline, each re-expressed for Spark.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
