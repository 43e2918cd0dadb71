"""Readers and writers: relational tables, N-Triples and Turtle text, Parquet graphs, text results."""
