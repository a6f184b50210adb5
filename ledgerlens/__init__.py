"""Forensic transaction analytics on Spark: composable DataFrame operators."""

__version__ = "0.1.0"
