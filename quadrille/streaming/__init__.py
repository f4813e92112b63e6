"""streaming of the RDF engine."""
