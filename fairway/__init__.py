"""Waterway trajectory analytics on PySpark."""
