"""Versioned-data and event-trace analytics on PySpark."""
