"""Scenario analytics on Spark: long scenario tables in, result tables out."""

__version__ = "0.1.0"
