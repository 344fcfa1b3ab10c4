"""Metric-space queries, mergeable statistics and traced optimisation on PySpark."""
