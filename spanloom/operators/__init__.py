"""Matching, recognition, resolution, grouping, metrics and model arithmetic on DataFrames."""
