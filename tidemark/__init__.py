"""Spark-first analytics for disclosure text, point-in-time joins, panels and training-data preparation."""
