"""Operators of a training-data pipeline, as Spark jobs; nothing outside uses them."""
