"""Benchmark audit and incident telemetry operators for PySpark."""
