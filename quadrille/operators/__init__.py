"""operators of the RDF engine."""
