"""Spark-first document-intelligence engine: DataFrame -> DataFrame operators."""
