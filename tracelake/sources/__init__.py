"""Sources and sinks: the driver's tables, derived fixtures, trace JSONL, stores and write-ahead logs."""
