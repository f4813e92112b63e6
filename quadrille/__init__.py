"""quadrille: RDF quads, SPARQL, OWL 2 RL and SHACL as Spark DataFrame plans."""
