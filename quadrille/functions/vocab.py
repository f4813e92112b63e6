"""IRIs of the vocabularies, in the encoded form <iri>."""

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
PROV = "http://www.w3.org/ns/prov#"

NUMERIC_RANK = {
    "integer": 0, "long": 0, "int": 0, "short": 0, "byte": 0, "nonNegativeInteger": 0, "positiveInteger": 0, "nonPositiveInteger": 0,
    "negativeInteger": 0, "unsignedLong": 0, "unsignedInt": 0, "unsignedShort": 0, "unsignedByte": 0, "decimal": 1, "float": 2, "double": 3,
}


def iri(x: str) -> str:
    return f"<{x}>"


TYPE = iri(RDF + "type")


def rdf(x: str) -> str:
    return iri(RDF + x)


def rdfs(x: str) -> str:
    return iri(RDFS + x)


def owl(x: str) -> str:
    return iri(OWL + x)


def sh(x: str) -> str:
    return iri(SH + x)


def xsd(x: str) -> str:
    return iri(XSD + x)
