"""Versioned tables and large-scale data preparation on Spark."""

__version__ = "0.1.0"
