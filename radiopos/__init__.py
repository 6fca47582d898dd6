"""Spark operators for cellular positioning data."""
