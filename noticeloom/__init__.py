"""Spark-first engine for public-notice data."""
