"""Registered queries, with the SQL that checks them."""

from . import check_queries, kv_queries, measure_queries, more_queries, range_queries, replica_queries, sql_queries  # noqa: F401
