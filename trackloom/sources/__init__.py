"""Readers of raw sensor files, as Spark data sources."""
