"""Monitoring of municipal finance and spending as Spark DataFrame operators."""

__version__ = "0.1.0"
