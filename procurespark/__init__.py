"""Procurement-catalog and protocol analytics on PySpark."""
