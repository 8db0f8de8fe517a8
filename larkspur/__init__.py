"""Larkspur: document-intelligence analytics expressed as Spark DataFrame jobs."""
