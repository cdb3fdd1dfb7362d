"""Quillon: retrieval, evaluation and telemetry analytics as PySpark jobs."""
