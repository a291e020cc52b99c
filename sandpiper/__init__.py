"""Sandpiper: market-style time series analytics written as Spark DataFrame jobs."""
