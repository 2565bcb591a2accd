"""Spindrift: decomposition and forecasting of many time series with Spark DataFrames."""
