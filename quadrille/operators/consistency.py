"""OWL 2 RL inconsistency detectors as SQL over triples {u} and lists {l}: each gives records (s, p, o)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import TYPE, owl
from . import lists
from .owl_rules import SAME, THING, can_hold, number, of, restriction, typed
from .reasoner import ask, vocabulary


class ConsistencyError(ValueError):
    pass


def _kind(name: str) -> str:
    return f"(SELECT x AS s FROM {typed(owl(name))} WHERE x LIKE '<%' AND x NOT LIKE '<<%')"


def _pairs(cls: str, predicates: list[str]) -> str:
    """(a, b), a < b: members of the lists of instances of cls."""
    links = " UNION ALL ".join(f"SELECT s, o FROM {of(owl(p))}" for p in predicates)
    return f"(SELECT DISTINCT least(x.item, y.item) AS a, greatest(x.item, y.item) AS b FROM {typed(owl(cls))} c JOIN ({links}) m ON m.s = c.x JOIN {{l}} x ON x.head = m.o JOIN {{l}} y ON y.head = m.o WHERE x.item <> y.item)"


def _disjoint(pairs: str) -> str:
    return f"SELECT x.x AS s, '{TYPE}' AS p, least(d.a, d.b) AS o FROM {pairs} d JOIN {typed()} x ON x.c = d.a JOIN {typed()} y ON y.c = d.b AND y.x = x.x"


def _shared(pairs: str) -> str:
    return f"SELECT t.s, least(d.a, d.b) AS p, t.o FROM {pairs} d JOIN {{u}} t ON t.p = d.a JOIN {{u}} t2 ON t2.p = d.b AND t2.s = t.s AND t2.o = t.o"


def _same(pairs: str) -> str:
    return f"SELECT least(d.a, d.b) AS s, '{SAME}' AS p, greatest(d.a, d.b) AS o FROM {pairs} d JOIN (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM {{u}} WHERE p = '{SAME}') e ON e.a = least(d.a, d.b) AND e.b = greatest(d.a, d.b) WHERE d.a <> d.b"


def _negative(target: str, literal: bool) -> str:
    """Of several sources, properties or targets of one assertion the least is taken."""
    least = lambda p: f"(SELECT s, min(o) AS o FROM {of(owl(p))} GROUP BY s)"
    return f"SELECT i.o AS s, a.o AS p, v.o FROM {least('sourceIndividual')} i JOIN {least('assertionProperty')} a ON a.s = i.s JOIN {least(target)} v ON v.s = i.s JOIN {{u}} t ON t.s = i.o AND t.p = a.o AND t.o = v.o WHERE v.o {'LIKE' if literal else 'NOT LIKE'} '\"%'"


def _most(kind: str, thing: bool | None) -> str:
    on = ""
    if thing is not None:
        on = f"JOIN (SELECT s, o AS d FROM {of(owl('onClass'))}) q ON q.s = r.c AND q.d {'=' if thing else '<>'} '{THING}'"
        if not thing:
            on += f" JOIN {typed()} y ON y.c = q.d AND y.x = t.o"
    return f"SELECT t.s, t.p, min(t.o) AS o FROM {restriction(kind)} r JOIN {typed()} x ON x.c = r.c JOIN {{u}} t ON t.s = x.x AND t.p = r.p {on} WHERE {number('r.v', 0)} GROUP BY t.s, t.p"


_PAIR = lambda p: f"(SELECT s AS a, o AS b FROM {of(owl(p))})"

DETECTORS: dict[str, str] = {
    "prp-irp": f"SELECT t.s, t.p, t.o FROM {{u}} t JOIN {_kind('IrreflexiveProperty')} k ON k.s = t.p WHERE t.s = t.o",
    "prp-asyp": f"SELECT t.s, t.p, t.o FROM {{u}} t JOIN {_kind('AsymmetricProperty')} k ON k.s = t.p JOIN {{u}} t2 ON t2.p = t.p AND t2.s = t.o AND t2.o = t.s WHERE t.s < t.o",
    "prp-pdw": _shared(_PAIR("propertyDisjointWith")),
    "prp-adp": _shared(_pairs("AllDisjointProperties", ["members"])),
    "prp-npa1": _negative("targetIndividual", False),
    "prp-npa2": _negative("targetValue", True),
    "cls-nothing2": f"SELECT x AS s, '{TYPE}' AS p, '{owl('Nothing')}' AS o FROM {typed(owl('Nothing'))}",
    "cls-com": _disjoint(_PAIR("complementOf")),
    "cls-maxc1": _most("maxCardinality", None),
    "cls-maxqc1": _most("maxQualifiedCardinality", False),
    "cls-maxqc2": _most("maxQualifiedCardinality", True),
    "cax-dw": _disjoint(_PAIR("disjointWith")),
    "cax-adc": _disjoint(_pairs("AllDisjointClasses", ["members", "distinctMembers"])),
    "eq-diff1": _same(_PAIR("differentFrom")),
    "eq-diff2": _same(_pairs("AllDifferent", ["members"])),
    "eq-diff3": _same(_pairs("AllDifferent", ["distinctMembers"])),
    "dt-not-type": "",
}


def bad_literals(u: DataFrame) -> DataFrame:
    """Literals whose lexical form their datatype excludes: whole numbers in 64 bits, their signs, and booleans."""
    lex = F.regexp_extract("o", r'(?s)^"(.*)"\^\^<', 1)
    dt = F.regexp_extract("o", r'"\^\^<http://www.w3.org/2001/XMLSchema#([A-Za-z]*)>$', 1)
    whole, digits = lex.rlike("^[+-]?[0-9]+$"), lex.rlike("^[+]?[0-9]+$")
    n = F.when(whole, F.regexp_replace(lex, "^[+]", "")).try_cast("decimal(38,0)")
    signed = F.coalesce(n.between(-(1 << 63), (1 << 63) - 1), F.lit(False))
    unsigned = digits & F.coalesce((n >= 0) & (n <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")), F.lit(False))
    good = (
        F.when(dt.isin("integer", "long", "int", "short", "byte"), signed).when(dt.isin("unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "nonNegativeInteger"), unsigned)
        .when(dt == "positiveInteger", unsigned & (n > 0)).when(dt == "nonPositiveInteger", signed & (n <= 0)).when(dt == "negativeInteger", signed & (n < 0))
        .when(dt == "boolean", lex.isin("true", "false", "0", "1")).otherwise(F.lit(True))
    )
    return u.where(F.startswith("o", F.lit('"')) & ~good).select("s", "p", "o")


def detect(u: DataFrame, name: str, l: DataFrame | None = None) -> DataFrame:
    """Distinct records (rule, s, p, o) of one detector over triples u."""
    if name == "dt-not-type":
        found = bad_literals(u)
    else:
        text = DETECTORS[name]
        if "{l}" in text and l is None:
            l = lists.walk(u)  # noqa: E741
        found = ask(u.sparkSession, text, u=u, l=l)
    return found.select(F.lit(name).alias("rule"), "s", "p", "o").distinct()


def violations(u: DataFrame, max_violations: int = 10_000) -> DataFrame:
    """Records of all detectors, by (rule, s, p, o). Reaching max_violations before the last detector is an error."""
    if max_violations <= 0:
        raise ConsistencyError(f"max_violations ({max_violations}) exceeded")
    l = lists.walk(u)  # noqa: E741
    there = vocabulary(u, tuple(DETECTORS.values()))
    found = {n: detect(u, n, l) for n in DETECTORS if can_hold(DETECTORS[n], there)}
    every = reduce(DataFrame.union, found.values())
    counts = {r["rule"]: r["count"] for r in every.groupBy("rule").count().collect()}
    total = 0
    for n in DETECTORS:
        if total >= max_violations:
            raise ConsistencyError(f"max_violations ({max_violations}) exceeded")
        total += counts.get(n, 0)
    return every.orderBy("rule", "s", "p", "o")
