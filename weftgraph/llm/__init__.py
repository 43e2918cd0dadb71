"""Training-data operators: deduplication, extraction, classification, formatting, mixing, encoding.

Nothing outside this subpackage imports it.  ``entry.queries()`` and ``entry.oracle_sql()`` hold the
queries that ``__spark_entry__`` registers when the subpackage is present.
"""
