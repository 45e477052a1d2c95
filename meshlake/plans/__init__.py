"""Hourly pre-aggregated tables: build, maintain and query."""
