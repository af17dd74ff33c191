"""Structured Streaming jobs: shipping, the hot tables, the live tail, counters and crash detection."""
