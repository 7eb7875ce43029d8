"""Labeled-post analytics as Spark DataFrame jobs."""
