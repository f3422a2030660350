"""Spark jobs over the books of road-building contracts."""
