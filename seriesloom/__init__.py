"""Spark-first feature engineering for time series."""
