"""Verdigris: spatial impact analytics on PySpark DataFrames."""
