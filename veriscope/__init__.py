"""Consistency analytics over outcome logs, as PySpark DataFrames."""
