"""Spark-first analytics over event and text data."""
