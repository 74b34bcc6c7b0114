"""Sequence and training-data analytics on PySpark: DataFrames in, DataFrames out."""

__version__ = "0.1.0"
