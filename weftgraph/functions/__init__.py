"""Expressions of the query language as Spark columns."""
