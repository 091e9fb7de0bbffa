"""Expressions of specifications as Spark columns and as Python, window functions."""
