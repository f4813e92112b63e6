"""The OWL 2 RL derivation rules as SQL over a view of triples (s, p, o) and a view of lists (head, pos, item, n).

Every rule reads {u} and {l} and gives (s, p, o). Spark plans all of a round as one query.
"""

from __future__ import annotations

import re

from ..functions.vocab import TYPE, owl, rdf, rdfs, xsd

SC, SP, DOM, RNG = rdfs("subClassOf"), rdfs("subPropertyOf"), rdfs("domain"), rdfs("range")
EQC, EQP, SAME, INV = owl("equivalentClass"), owl("equivalentProperty"), owl("sameAs"), owl("inverseOf")
THING, NOTHING, CLASS, ON = owl("Thing"), owl("Nothing"), owl("Class"), owl("onProperty")
DATATYPE, CHAIN = rdfs("Datatype"), owl("propertyChainAxiom")

#: The datatypes of OWL 2 RL.
DATATYPES = [rdf("PlainLiteral"), rdf("XMLLiteral")] + [
    xsd(x) for x in (
        "anyURI", "base64Binary", "boolean", "byte", "dateTime", "dateTimeStamp", "decimal", "double", "float", "hexBinary", "int", "integer", "language",
        "long", "Name", "NCName", "negativeInteger", "NMTOKEN", "nonNegativeInteger", "nonPositiveInteger", "normalizedString", "positiveInteger",
        "short", "string", "token", "unsignedByte", "unsignedInt", "unsignedLong", "unsignedShort",
    )
]


def needs(text: str) -> set[str]:
    """Predicates and classes without which a rule's SQL gives nothing."""
    return {m[1] for m in re.finditer(r"\b(?:p|o) = '(<[^']+>)'", text)} - {TYPE}


def can_hold(text: str, there: set[str]) -> bool:
    """Whether a rule's SQL can give something where only these predicates and classes occur. Of the branches of a UNION,
    in parentheses or outside, one is enough."""
    stack: list[tuple[bool, bool]] = []  # of open parentheses: (an earlier branch can, all of this branch can)
    some, every = False, True
    for m in re.finditer(r"\b(?:p|o) = '(<[^']+>)'|'[^']*'|\bUNION\b|[()]", text):
        if m[1]:
            every &= m[1] == TYPE or m[1] in there
        elif m[0] == "UNION":
            some, every = some or every, True
        elif m[0] == "(":
            stack.append((some, every))
            some, every = False, True
        elif m[0] == ")":
            inner = some or every
            some, every = stack.pop()
            every &= inner
    return some or every


def of(p: str) -> str:
    """(s, o) of a predicate."""
    return f"(SELECT s, o FROM {{u}} WHERE p = '{p}')"


def typed(c: str | None = None) -> str:
    """(x, c) of rdf:type, or the instances x of one class."""
    return f"(SELECT s AS x, o AS c FROM {{u}} WHERE p = '{TYPE}')" if c is None else f"(SELECT s AS x FROM {{u}} WHERE p = '{TYPE}' AND o = '{c}')"


def restriction(kind: str) -> str:
    """(c, v, p): class c restricts property p by owl:kind v."""
    return f"(SELECT a.s AS c, a.o AS v, b.o AS p FROM {of(owl(kind))} a JOIN {of(ON)} b ON a.s = b.s WHERE b.o LIKE '<%' AND b.o NOT LIKE '<<%')"


def listed(p: str) -> str:
    """(c, pos, item, n): class or property c has a list as its p."""
    return f"(SELECT a.s AS c, a.o AS head, l.pos, l.item, l.n FROM {of(p)} a JOIN {{l}} l ON a.o = l.head)"


_RES = lambda c: f"{c} NOT LIKE '\"%'"  # noqa: E731  not a literal
_IRI = lambda c: f"{c} LIKE '<%' AND {c} NOT LIKE '<<%'"


def number(c: str, n: int) -> str:
    """The lexical form of a literal is the given whole number, whatever its datatype."""
    return f"{c} RLIKE r'^\"[+]?0*{n}\"($|\\^\\^|@)'"


def _through(p: str) -> str:
    return f"SELECT a.s, '{p}' AS p, b.o FROM {of(p)} a JOIN {of(p)} b ON a.o = b.s WHERE {_RES('a.o')}"


def _both_ways(p: str, sub: str) -> str:
    return f"SELECT s, '{sub}' AS p, o FROM {of(p)} WHERE {_RES('o')} UNION ALL SELECT o, '{sub}', s FROM {of(p)} WHERE {_RES('o')}"


def _mutual(sub: str, eq: str) -> str:
    return f"SELECT a.s, '{eq}' AS p, a.o FROM {of(sub)} a JOIN {of(sub)} b ON a.s = b.o AND a.o = b.s"


def _propagate(p: str) -> str:
    """u(p, action target): s p o with an axiom on p."""
    return f"FROM {{u}} t JOIN {p} a ON t.p = a.s"


def _same(pairs: str) -> str:
    return f"SELECT y1 AS s, '{SAME}' AS p, y2 AS o FROM ({pairs}) WHERE y1 <> y2 AND {_RES('y1')} AND {_RES('y2')}"


def _some_sub(kind: str) -> str:
    r = restriction(kind)
    return f"SELECT a.c AS s, '{SC}' AS p, b.c AS o FROM {r} a JOIN {of(SC)} y ON a.v = y.s JOIN {r} b ON b.v = y.o AND b.p = a.p"


def _prop_sub(kind: str, flip: bool) -> str:
    r = restriction(kind)
    s, o = ("b.c", "a.c") if flip else ("a.c", "b.c")
    return f"SELECT {s} AS s, '{SC}' AS p, {o} AS o FROM {r} a JOIN {of(SP)} q ON a.p = q.s JOIN {r} b ON b.p = q.o AND b.v = a.v"


def _qualified(thing: bool) -> str:
    r = f"(SELECT r.c, r.p, q.o AS d FROM {restriction('maxQualifiedCardinality')} r JOIN {of(owl('onClass'))} q ON r.c = q.s WHERE {number('r.v', 1)})"
    if thing:
        return f"SELECT t1.o AS y1, t2.o AS y2 FROM {r} r JOIN {typed()} x ON x.c = r.c JOIN {{u}} t1 ON t1.s = x.x AND t1.p = r.p JOIN {{u}} t2 ON t2.s = x.x AND t2.p = r.p WHERE r.d = '{THING}'"
    return (
        f"SELECT t1.o AS y1, t2.o AS y2 FROM {r} r JOIN {typed()} x ON x.c = r.c JOIN {{u}} t1 ON t1.s = x.x AND t1.p = r.p JOIN {{u}} t2 ON t2.s = x.x AND t2.p = r.p "
        f"JOIN {typed()} c1 ON c1.x = t1.o AND c1.c = r.d JOIN {typed()} c2 ON c2.x = t2.o AND c2.c = r.d WHERE r.d <> '{THING}'"
    )


def _values(rows: list[tuple[str, str, str]]) -> str:
    return "SELECT * FROM VALUES " + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in rows) + " AS v(s, p, o)"


def _schema(cls: str, sub: str, eq: str) -> str:
    return f"SELECT x AS s, '{sub}' AS p, x AS o FROM {typed(cls)} UNION ALL SELECT x, '{eq}', x FROM {typed(cls)}"


def _kind(cls: str) -> str:
    return f"(SELECT x AS s FROM {typed(cls)} WHERE {_IRI('x')})"


_KEYS = f"""SELECT x.c, x.x AS x1, y.x AS x2 FROM
 (SELECT k.c, k.pos, k.n, k.head, t.x, v.o FROM {listed(owl('hasKey'))} k JOIN {typed()} t ON t.c = k.c JOIN {{u}} v ON v.s = t.x AND v.p = k.item) x JOIN
 (SELECT k.c, k.pos, k.head, t.x, v.o FROM {listed(owl('hasKey'))} k JOIN {typed()} t ON t.c = k.c JOIN {{u}} v ON v.s = t.x AND v.p = k.item) y
 ON x.c = y.c AND x.head = y.head AND x.pos = y.pos AND x.o = y.o AND x.x <> y.x
 GROUP BY x.c, x.head, x.n, x.x, y.x HAVING count(DISTINCT x.pos) = x.n"""

RULES: dict[str, str] = {
    "scm-sco": _through(SC),
    "scm-spo": _through(SP),
    "scm-eqc1": _both_ways(EQC, SC),
    "scm-eqp1": _both_ways(EQP, SP),
    "cax-sco": f"SELECT t.x AS s, '{TYPE}' AS p, c.o FROM {typed()} t JOIN {of(SC)} c ON t.c = c.s",
    "prp-spo1": f"SELECT t.s, a.o AS p, t.o {_propagate(of(SP))} WHERE {_IRI('a.o')}",
    "prp-dom": f"SELECT t.s, '{TYPE}' AS p, a.o {_propagate(of(DOM))}",
    "prp-rng": f"SELECT t.o AS s, '{TYPE}' AS p, a.o {_propagate(of(RNG))} WHERE {_RES('t.o')}",
    "prp-trp": f"SELECT t.s, t.p, t2.o {_propagate(_kind(owl('TransitiveProperty')))} JOIN {{u}} t2 ON t2.p = t.p AND t2.s = t.o",
    "prp-symp": f"SELECT t.o AS s, t.p, t.s AS o {_propagate(_kind(owl('SymmetricProperty')))} WHERE {_RES('t.o')}",
    "prp-inv1": f"SELECT t.o AS s, a.o AS p, t.s AS o {_propagate(of(INV))} WHERE {_RES('t.o')} AND {_IRI('a.o')}",
    "prp-inv2": f"SELECT t.o AS s, a.s AS p, t.s AS o FROM {{u}} t JOIN {of(INV)} a ON t.p = a.o WHERE {_RES('t.o')} AND {_IRI('a.s')}",
    "prp-fp": _same(f"SELECT t.o AS y1, t2.o AS y2 {_propagate(_kind(owl('FunctionalProperty')))} JOIN {{u}} t2 ON t2.p = t.p AND t2.s = t.s"),
    "eq-sym": f"SELECT o AS s, '{SAME}' AS p, s AS o FROM {of(SAME)} WHERE {_RES('o')}",
    "eq-trans": _through(SAME),
    "scm-cls": f"SELECT x AS s, stack(3, '{SC}', x, '{EQC}', x, '{SC}', '{THING}') AS (p, o) FROM {typed(CLASS)} UNION ALL SELECT '{NOTHING}', '{SC}', x FROM {typed(CLASS)}",
    "scm-op": _schema(owl("ObjectProperty"), SP, EQP),
    "scm-dp": _schema(owl("DatatypeProperty"), SP, EQP),
    "scm-eqc2": _mutual(SC, EQC),
    "scm-eqp2": _mutual(SP, EQP),
    "scm-dom1": f"SELECT a.s, '{DOM}' AS p, c.o FROM {of(DOM)} a JOIN {of(SC)} c ON a.o = c.s",
    "scm-dom2": f"SELECT q.s, '{DOM}' AS p, a.o FROM {of(DOM)} a JOIN {of(SP)} q ON q.o = a.s",
    "scm-rng1": f"SELECT a.s, '{RNG}' AS p, c.o FROM {of(RNG)} a JOIN {of(SC)} c ON a.o = c.s",
    "scm-rng2": f"SELECT q.s, '{RNG}' AS p, a.o FROM {of(RNG)} a JOIN {of(SP)} q ON q.o = a.s",
    "scm-hv": _prop_sub("hasValue", False),
    "scm-svf1": _some_sub("someValuesFrom"),
    "scm-svf2": _prop_sub("someValuesFrom", False),
    "scm-avf1": _some_sub("allValuesFrom"),
    "scm-avf2": _prop_sub("allValuesFrom", True),
    "scm-int": f"SELECT c AS s, '{SC}' AS p, item AS o FROM {listed(owl('intersectionOf'))}",
    "scm-uni": f"SELECT item AS s, '{SC}' AS p, c AS o FROM {listed(owl('unionOf'))} WHERE {_RES('item')}",
    "cls-thing": _values([(THING, TYPE, CLASS)]),
    "cls-nothing1": _values([(NOTHING, TYPE, CLASS)]),
    "cls-int1": f"SELECT t.x AS s, '{TYPE}' AS p, l.c AS o FROM (SELECT DISTINCT c, head, item FROM {listed(owl('intersectionOf'))}) l JOIN {typed()} t ON t.c = l.item JOIN (SELECT c, head, count(DISTINCT item) AS n FROM {listed(owl('intersectionOf'))} GROUP BY c, head) k ON k.c = l.c AND k.head = l.head GROUP BY t.x, l.c, l.head, k.n HAVING count(DISTINCT l.item) = k.n",
    "cls-int2": f"SELECT t.x AS s, '{TYPE}' AS p, l.item AS o FROM {listed(owl('intersectionOf'))} l JOIN {typed()} t ON t.c = l.c",
    "cls-uni": f"SELECT t.x AS s, '{TYPE}' AS p, l.c AS o FROM {listed(owl('unionOf'))} l JOIN {typed()} t ON t.c = l.item",
    "cls-svf1": f"SELECT t.s, '{TYPE}' AS p, r.c AS o FROM {restriction('someValuesFrom')} r JOIN {{u}} t ON t.p = r.p JOIN {typed()} y ON y.x = t.o AND y.c = r.v",
    "cls-svf2": f"SELECT t.s, '{TYPE}' AS p, r.c AS o FROM {restriction('someValuesFrom')} r JOIN {{u}} t ON t.p = r.p WHERE r.v = '{THING}'",
    "cls-avf": f"SELECT t.o AS s, '{TYPE}' AS p, r.v AS o FROM {restriction('allValuesFrom')} r JOIN {typed()} x ON x.c = r.c JOIN {{u}} t ON t.s = x.x AND t.p = r.p WHERE {_RES('t.o')}",
    "cls-hv1": f"SELECT x.x AS s, r.p, r.v AS o FROM {restriction('hasValue')} r JOIN {typed()} x ON x.c = r.c",
    "cls-hv2": f"SELECT t.s, '{TYPE}' AS p, r.c AS o FROM {restriction('hasValue')} r JOIN {{u}} t ON t.p = r.p AND t.o = r.v",
    "cls-maxc2": _same(f"SELECT t1.o AS y1, t2.o AS y2 FROM {restriction('maxCardinality')} r JOIN {typed()} x ON x.c = r.c JOIN {{u}} t1 ON t1.s = x.x AND t1.p = r.p JOIN {{u}} t2 ON t2.s = x.x AND t2.p = r.p WHERE {number('r.v', 1)}"),
    "cls-maxqc3": _same(_qualified(False)),
    "cls-maxqc4": _same(_qualified(True)),
    "cls-oo": f"SELECT item AS s, '{TYPE}' AS p, c AS o FROM {listed(owl('oneOf'))} WHERE {_RES('item')}",
    "cax-eqc1": f"SELECT t.x AS s, '{TYPE}' AS p, c.o FROM {typed()} t JOIN {of(EQC)} c ON t.c = c.s",
    "cax-eqc2": f"SELECT t.x AS s, '{TYPE}' AS p, c.s AS o FROM {typed()} t JOIN {of(EQC)} c ON t.c = c.o",
    "prp-ifp": _same(f"SELECT t.s AS y1, t2.s AS y2 {_propagate(_kind(owl('InverseFunctionalProperty')))} JOIN {{u}} t2 ON t2.p = t.p AND t2.o = t.o"),
    "prp-spo2": "",  # one join per hop: see chains()
    "prp-eqp1": f"SELECT t.s, a.o AS p, t.o {_propagate(of(EQP))} WHERE {_IRI('a.o')}",
    "prp-eqp2": f"SELECT t.s, a.s AS p, t.o FROM {{u}} t JOIN {of(EQP)} a ON t.p = a.o WHERE {_IRI('a.s')}",
    "prp-key": f"SELECT x1 AS s, '{SAME}' AS p, x2 AS o FROM ({_KEYS})",
    "eq-ref": f"SELECT DISTINCT x AS s, '{SAME}' AS p, x AS o FROM (SELECT s AS x FROM {{u}} UNION SELECT p FROM {{u}} UNION SELECT o FROM {{u}} WHERE {_RES('o')})",
    "eq-rep-s": f"SELECT a.o AS s, t.p, t.o FROM {of(SAME)} a JOIN {{u}} t ON t.s = a.s WHERE a.s <> a.o AND {_RES('a.o')}",
    "eq-rep-p": f"SELECT t.s, a.o AS p, t.o FROM {of(SAME)} a JOIN {{u}} t ON t.p = a.s WHERE a.s <> a.o AND {_IRI('a.o')}",
    "eq-rep-o": f"SELECT t.s, t.p, a.o FROM {of(SAME)} a JOIN {{u}} t ON t.o = a.s WHERE a.s <> a.o",
    "dt-type1": _values([(d, TYPE, DATATYPE) for d in DATATYPES]),
    "dt-type2": f"SELECT DISTINCT CASE WHEN o RLIKE r'\"\\^\\^<[^\">]*>$' THEN regexp_extract(o, r'\"\\^\\^(<[^\">]*>)$', 1) WHEN o RLIKE r'\"@[A-Za-z0-9-]+$' THEN '{rdf('langString')}' ELSE '{xsd('string')}' END AS s, '{TYPE}' AS p, '{DATATYPE}' AS o FROM {{u}} WHERE o LIKE '\"%'",
    "dt-eq": "",  # equality of literals as subjects can't be stated
    "dt-diff": "",
}

#: Rules that an option switches.
SATURATION = ("eq-rep-s", "eq-rep-p", "eq-rep-o")
REFLEXIVE = ("eq-ref",)
LIST_RULES = ("scm-int", "scm-uni", "cls-int1", "cls-int2", "cls-uni", "cls-oo", "prp-spo2", "prp-key")


def chains(lengths: list[int]) -> str:
    """prp-spo2 for the chain lengths that occur."""
    parts = []
    for n in lengths:
        hops = " ".join(f"JOIN {{l}} l{i} ON l{i}.head = a.o AND l{i}.pos = {i} JOIN {{u}} t{i} ON t{i}.p = l{i}.item" + (f" AND t{i}.s = t{i - 1}.o" if i else "") for i in range(n))
        parts.append(f"SELECT DISTINCT t0.s, a.s AS p, t{n - 1}.o FROM {of(owl('propertyChainAxiom'))} a {hops} WHERE l0.n = {n} AND {_IRI('a.s')}")
    return " UNION ALL ".join(parts)


#: Premises of the rules whose derivations are recorded: SQL giving (s, p, o, s1, p1, o1, g1, s2, p2, o2, g2) over quads {q}.
def _tracked_transitive(p: str) -> str:
    return f"SELECT a.s, '{p}' AS p, b.o, a.s AS s1, a.p AS p1, a.o AS o1, a.g AS g1, b.s AS s2, b.p AS p2, b.o AS o2, b.g AS g2 FROM {{q}} a JOIN {{q}} b ON a.o = b.s WHERE a.p = '{p}' AND b.p = '{p}'"


TRACKED = {
    "scm-sco": _tracked_transitive(SC),
    "scm-spo": _tracked_transitive(SP),
    "eq-trans": _tracked_transitive(SAME),
    "cax-sco": f"SELECT a.s, '{TYPE}' AS p, b.o, a.s AS s1, a.p AS p1, a.o AS o1, a.g AS g1, b.s AS s2, b.p AS p2, b.o AS o2, b.g AS g2 FROM {{q}} a JOIN {{q}} b ON a.o = b.s WHERE a.p = '{TYPE}' AND b.p = '{SC}'",
    "prp-spo1": f"SELECT a.s, b.o AS p, a.o, a.s AS s1, a.p AS p1, a.o AS o1, a.g AS g1, b.s AS s2, b.p AS p2, b.o AS o2, b.g AS g2 FROM {{q}} a JOIN {{q}} b ON a.p = b.s WHERE b.p = '{SP}' AND {_IRI('b.o')}",
}
