"""Spark-native time-series cleaning, segmentation and forecasting."""

__version__ = "0.1.0"
