"""SPARQL algebra. Terms are encoded strings; variables are Var; quoted patterns with variables are Quoted."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Quoted:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Path:
    """kind: link, inv, seq, alt, star, plus, opt, neg; parts: IRIs of a link, IRIs of a neg and its inverse ones, else paths."""

    kind: str
    parts: tuple


@dataclass
class BGP:
    triples: list


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    on: object = None


@dataclass
class Union:
    parts: list


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    expr: object
    inner: object


@dataclass
class Extend:
    inner: object
    var: str
    expr: object


@dataclass
class Values:
    names: list
    rows: list


@dataclass
class Graph:
    name: object
    inner: object


@dataclass
class Service:
    silent: bool


@dataclass
class Query:
    form: str
    where: object
    select: list | None = None  # of (name, expr or None); None: all
    distinct: bool = False
    group: list | None = None  # of (expr, name or None)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # of (expr, ascending)
    limit: int | None = None
    offset: int = 0
    values: Values | None = None
    template: list | None = None
    describe: list | None = None
    default: list | None = None  # FROM
    named: list | None = None  # FROM NAMED


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    name: str
    arg: object  # None for COUNT(*)
    distinct: bool = False
    separator: str = " "


@dataclass
class Exists:
    inner: object
    negated: bool


@dataclass
class Update:
    kind: str  # insert_data, delete_data, modify, clear, create, load, add
    delete: list = field(default_factory=list)  # of (s, p, o, g)
    insert: list = field(default_factory=list)
    where: object = None
    using: list | None = None
    using_named: list | None = None
    target: str = ""
    source: str = ""
    silent: bool = False
    verb: str = ""


def variables(node) -> list[str]:
    """Names in scope of a pattern, in order of appearance."""
    out: dict[str, None] = {}

    def term(t) -> None:
        if isinstance(t, Var):
            out.setdefault(t.name)
        elif isinstance(t, Quoted):
            term(t.s), term(t.p), term(t.o)

    def walk(n) -> None:
        if isinstance(n, BGP):
            for s, p, o in n.triples:
                term(s), term(p), term(o)
        elif isinstance(n, (Join, LeftJoin)):
            walk(n.left), walk(n.right)
        elif isinstance(n, Minus):
            walk(n.left)
        elif isinstance(n, Union):
            for x in n.parts:
                walk(x)
        elif isinstance(n, Filter):
            walk(n.inner)
        elif isinstance(n, Extend):
            walk(n.inner)
            out.setdefault(n.var)
        elif isinstance(n, Values):
            for x in n.names:
                out.setdefault(x)
        elif isinstance(n, Graph):
            term(n.name), walk(n.inner)
        elif isinstance(n, Query):
            for x in projection(n):
                out.setdefault(x)

    walk(node)
    return [x for x in out if not x.startswith(".")]


def projection(q: Query) -> list[str]:
    return [n for n, _ in q.select] if q.select is not None else variables(q.where)
