"""Declarative stream monitoring and corpus processing on Spark DataFrames."""
