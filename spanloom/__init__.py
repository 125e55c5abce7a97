"""Timed-segment analytics on PySpark."""
