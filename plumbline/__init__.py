"""Evaluation analytics on PySpark."""

__version__ = "0.3.0"
