"""functions of the RDF engine."""
