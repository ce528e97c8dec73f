"""Supplier-to-tender analytics expressed as Spark DataFrame jobs."""
