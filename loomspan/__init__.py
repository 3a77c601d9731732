"""Spark-first analytics for numeric arrays, time series and embedding vectors."""
