"""Spanloom: interaction-log analytics and closed-form recommendation on Spark DataFrames."""

__version__ = "0.1.0"
