"""Incremental forms of the trace operators, on Structured Streaming."""
