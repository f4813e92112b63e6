"""plans of the RDF engine."""
