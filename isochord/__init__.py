"""Representational-alignment analytics as Spark DataFrame jobs."""
