"""Readers for packet tables and message streams."""
