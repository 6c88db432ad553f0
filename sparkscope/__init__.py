"""Telemetry analytics on Spark: metrics, traces, logs and events as DataFrames."""
