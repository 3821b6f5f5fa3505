"""Spark-first engine that turns documents into typed blocks and processes them at scale."""

__version__ = "0.1.0"
