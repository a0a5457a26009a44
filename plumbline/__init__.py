"""plumbline: declarative casts and validation for Spark DataFrames."""

__version__ = "0.1.0"
