"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; ``catalog`` holds its
queries and their SQL.
"""
