"""Urbanloom: a Spark-first analytics engine for semantic 3D city models."""

__version__ = "0.1.0"
