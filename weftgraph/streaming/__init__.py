"""Continuous intake of queries."""
