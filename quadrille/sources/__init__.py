"""sources of the RDF engine."""
