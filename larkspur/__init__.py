"""Larkspur: a Spark-first engine for statistical table files and the analytics around them."""

__version__ = "0.1.0"
