"""Graph-pattern analytics over RDF triples and relational tables, as Spark DataFrames."""
