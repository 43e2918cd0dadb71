"""Operators on graphs, relations of bindings, dictionaries, id lists and signatures."""
