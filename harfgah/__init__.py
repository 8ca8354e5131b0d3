"""Spark-first engine for converting Latin-typed Persian and for the text statistics around it."""

__version__ = "0.1.0"
