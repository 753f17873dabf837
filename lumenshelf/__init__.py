"""Lumenshelf: content-recommendation analytics as lazy Spark DataFrame operators."""
