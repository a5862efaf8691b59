"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; `queries.py` holds the thin registered queries and their SQL.
"""
