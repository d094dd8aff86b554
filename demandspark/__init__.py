"""Demand time series and rule-based pricing on Spark DataFrames."""

__version__ = "0.1.0"
