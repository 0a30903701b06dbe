"""Audit analytics over many code repositories as Spark DataFrame jobs."""
