"""Turtle and N-Triples, quoted triples and annotations included: text to encoded (s, p, o) rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from ..functions.terms import literal
from ..functions.vocab import RDF, TYPE, XSD

TOKEN = re.compile(
    r"""(?P<ws>(?:\s|\#[^\n]*)+)
  |(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})
  |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<iri><(?!<)[^\x00-\x20<>"{}|^`]*>)
  |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  |(?P<var>[?$]\w+)
  |(?P<bnode>_:[\w](?:[\w.\-·]*[\w\-·])?)
  |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  |(?P<op><<|>>|\{\||\|\}|\^\^|\|\||&&|!=|<=|>=|[{}()\[\];,.=<>!+\-*/|^?])
  |(?P<pname>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.\-:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  |(?P<word>[A-Za-z_][\w]*)""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class RdfError(ValueError):
    """RDF parse error: ..."""


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            if m[3] not in _PLAIN:
                raise RdfError(f"RDF parse error: bad escape \\{m[3]}")
            return _PLAIN[m[3]]
        return chr(int(m[1] or m[2], 16))

    return _ESCAPE.sub(one, text) if "\\" in text else text


def tokens(text: str, error: type[Exception], label: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise error(f"{label}: unexpected {text[at : at + 12]!r} at {at}")
        if m.lastgroup != "ws":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    out.append(("end", "", at))
    return out


class TermReader:
    """Token access and term syntax that Turtle and SPARQL share."""

    error, label = RdfError, "RDF parse error"

    def __init__(self, text: str):
        self.toks, self.at = tokens(text, self.error, self.label), 0
        self.base, self.prefixes = "", {}

    def fail(self, what: str):
        kind, value, at = self.toks[self.at]
        raise self.error(f"{self.label}: expected {what}, found {value or kind!r} at {at}")

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[min(self.at + ahead, len(self.toks) - 1)][:2]

    def take(self) -> tuple[str, str]:
        t = self.toks[self.at][:2]
        self.at += 1
        return t

    def has(self, value: str) -> bool:
        kind, v = self.peek()
        return (kind == "op" and v == value) or (kind in ("word", "pname") and v.upper() == value.upper() and value.isalpha())

    def accept(self, value: str) -> bool:
        if self.has(value):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            self.fail(repr(value))

    def resolve(self, raw: str) -> str:
        raw = unescape(raw)
        return urljoin(self.base, raw) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", raw) else raw

    def iri(self) -> str:
        """A bare IRI."""
        kind, v = self.take()
        if kind == "iri":
            return self.resolve(v[1:-1])
        if kind == "pname":
            name, local = v.split(":", 1)
            if name not in self.prefixes:
                raise self.error(f"{self.label}: prefix {name}: isn't declared")
            return self.prefixes[name] + re.sub(r"\\(.)", r"\1", local)
        self.at -= 1
        self.fail("an IRI")

    def literal_token(self) -> str:
        kind, v = self.take()
        if kind in ("str", "long"):
            quote = 3 if kind == "long" else 1
            value = unescape(v[quote:-quote])
            if self.peek()[0] == "lang":
                return literal(value, lang=self.take()[1][1:].lower())
            if self.accept("^^"):
                return literal(value, self.iri())
            return literal(value)
        if kind == "num":
            return literal(v, XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"))
        if kind == "word" and v in ("true", "false"):
            return literal(v, XSD + "boolean")
        self.at -= 1
        self.fail("a term")

    def prologue_item(self) -> bool:
        """One BASE or PREFIX declaration, in either style."""
        kind, v = self.peek()
        name = v.lower().lstrip("@")
        if name not in ("prefix", "base") or kind not in ("word", "lang"):
            return False
        self.take()
        if name == "prefix":
            p = self.take()
            if p[0] != "pname" or not p[1].endswith(":"):
                self.at -= 1
                self.fail("a prefix")
            self.prefixes[p[1][:-1]] = self.resolve(self.take()[1][1:-1])
        else:
            self.base = self.resolve(self.take()[1][1:-1])
        if kind == "lang":
            self.expect(".")
        return True


class TurtleReader(TermReader):
    """Rows of a document; blank labels get `scope`, so that labels of different documents stay apart."""

    def __init__(self, text: str, scope: str = ""):
        super().__init__(text)
        self.scope, self.fresh, self.rows = scope, 0, []

    def blank(self) -> str:
        self.fresh += 1
        return f"_:g{self.fresh}{self.scope}"

    def document(self) -> Iterator[tuple[str, str, str]]:
        while self.peek()[0] != "end":
            if self.prologue_item():
                continue
            if self.peek() == ("op", "["):
                subject = self.node()
                if self.peek() != ("op", "."):
                    self.properties(subject)
            else:
                subject = self.node(subject=True)
                self.properties(subject)
            self.expect(".")
            yield from self.rows
            self.rows = []

    def verb(self) -> str:
        if self.peek() == ("word", "a"):
            self.take()
            return TYPE
        return f"<{self.iri()}>"

    def properties(self, subject: str) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.node()
                self.rows.append((subject, p, o))
                if self.accept("{|"):
                    self.properties(f"<< {subject} {p} {o} >>")
                    self.expect("|}")
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek()[0] == "op" and self.peek()[1] in (".", "]", "|}"):
                return

    def node(self, subject: bool = False) -> str:
        kind, v = self.peek()
        if kind in ("iri", "pname"):
            return f"<{self.iri()}>"
        if kind == "bnode":
            return self.take()[1] + self.scope
        if v == "<<":
            self.take()
            s, p, o = self.node(True), self.verb(), self.node()
            self.expect(">>")
            return f"<< {s} {p} {o} >>"
        if v == "[" and kind == "op":
            self.take()
            b = self.blank()
            if not self.accept("]"):
                self.properties(b)
                self.expect("]")
            return b
        if v == "(" and kind == "op":
            self.take()
            items = []
            while not self.accept(")"):
                items.append(self.node())
            if not items:
                return f"<{RDF}nil>"
            cells = [self.blank() for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items)):
                self.rows.append((cell, f"<{RDF}first>", item))
                self.rows.append((cell, f"<{RDF}rest>", cells[i + 1] if i + 1 < len(cells) else f"<{RDF}nil>"))
            return cells[0]
        if subject:
            self.fail("a subject")
        return self.literal_token()


def parse_turtle(text: str, scope: str = "") -> list[tuple[str, str, str]]:
    return list(TurtleReader(text, scope).document())


_LINE = re.compile(
    r"""(?:[ \t]*(?P<s><[^\x00-\x20<>"{}|^`]*>|_:[\w](?:[\w.\-·]*[\w\-·])?|<<.*>>)[ \t]*(?P<p><[^\x00-\x20<>"{}|^`]*>)[ \t]*
    (?P<o><[^\x00-\x20<>"{}|^`]*>|_:[\w](?:[\w.\-·]*[\w\-·])?|<<.*>>|"(?:[^"\\\n\r]|\\.)*"(?:@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*|\^\^<[^\x00-\x20<>"{}|^`]*>)?)[ \t]*\.)?[ \t]*(?:\#.*)?""",
    re.X,
)


def parse_ntriples(text: str, scope: str = "") -> list[tuple[str, str, str]]:
    """Rows of N-Triples: one triple a line, absolute IRIs, nothing of Turtle's shorthand."""
    for i, line in enumerate(re.split(r"[\r\n]+", text), 1):
        m = _LINE.fullmatch(line)
        if m is None or any(x and x.startswith("<") and not x.startswith("<<") and ":" not in x for x in (m["s"], m["p"], m["o"])):
            raise RdfError(f"RDF parse error: line {i} isn't a triple of N-Triples")
    return parse_turtle(text, scope)
