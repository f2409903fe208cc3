"""Spark-first operators for archives of spoken lines and their transcripts."""
