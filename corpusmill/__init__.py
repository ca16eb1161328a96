"""Corpus search, ranking and assessment as Spark DataFrame operators."""

__version__ = "0.1.0"
