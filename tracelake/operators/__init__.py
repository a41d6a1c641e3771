"""Operators over versioned key-value logs, command logs, ranges and event traces."""
