"""Telemetry analytics on Spark: OTLP batches in, deduplicated tables and named answers out."""
