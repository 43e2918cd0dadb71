"""SPARQL text to syntax trees."""
