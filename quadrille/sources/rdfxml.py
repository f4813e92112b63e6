"""RDF/XML: text to encoded (s, p, o) rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from ..functions.terms import literal
from ..functions.vocab import RDF, TYPE
from .turtle import RdfError

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"
_SYNTAX = {"RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "li", "Description"}


class _Reader:
    def __init__(self, scope: str):
        self.scope, self.fresh, self.rows = scope, 0, []

    def blank(self, label: str | None = None) -> str:
        if label is not None:
            return f"_:{label}{self.scope}"
        self.fresh += 1
        return f"_:x{self.fresh}{self.scope}"

    @staticmethod
    def name(tag: str) -> str:
        if not tag.startswith("{"):
            raise RdfError(f"RDF parse error: {tag} has no namespace")
        return tag[1:].replace("}", "", 1)

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if _R + "about" in e.attrib:
            subject = f"<{urljoin(base, e.get(_R + 'about'))}>"
        elif _R + "ID" in e.attrib:
            subject = f"<{urljoin(base, '#' + e.get(_R + 'ID'))}>"
        else:
            subject = self.blank(e.get(_R + "nodeID"))
        if e.tag != _R + "Description":
            self.rows.append((subject, TYPE, f"<{self.name(e.tag)}>"))
        self.attributes(e, subject, lang)
        count = 0
        for child in e:
            tag = self.name(child.tag)
            if tag == RDF + "li":
                count += 1
                tag = f"{RDF}_{count}"
            self.property(child, subject, f"<{tag}>", base, lang)
        return subject

    def attributes(self, e: ET.Element, subject: str, lang: str | None) -> None:
        for k, v in e.attrib.items():
            if k.startswith(_XML) or (k.startswith(_R) and k[len(_R) :] in _SYNTAX):
                continue
            p = f"<{self.name(k)}>"
            self.rows.append((subject, p, f"<{v}>" if p == TYPE else literal(v, lang=lang.lower() if lang else None)))

    def property(self, e: ET.Element, subject: str, p: str, base: str, lang: str | None) -> None:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        kind = e.get(_R + "parseType")
        if kind == "Resource":
            o = self.blank()
            for child in e:
                self.property(child, o, f"<{self.name(child.tag)}>", base, lang)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in e]
            cells = [self.blank() for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items)):
                self.rows += [(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", cells[i + 1] if i + 1 < len(cells) else f"<{RDF}nil>")]
            o = cells[0] if cells else f"<{RDF}nil>"
        elif kind is not None:
            o = literal((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), RDF + "XMLLiteral")
        elif len(e):
            o = self.node(e[0], base, lang)
        elif _R + "resource" in e.attrib:
            o = f"<{urljoin(base, e.get(_R + 'resource'))}>"
            self.attributes(e, o, lang)
        elif _R + "nodeID" in e.attrib:
            o = self.blank(e.get(_R + "nodeID"))
            self.attributes(e, o, lang)
        elif any(not k.startswith(_XML) and k not in (_R + "datatype", _R + "ID") for k in e.attrib):
            o = self.blank()
            self.attributes(e, o, lang)
        else:
            o = literal(e.text or "", e.get(_R + "datatype"), None if _R + "datatype" in e.attrib else (lang.lower() if lang else None))
        self.rows.append((subject, p, o))
        if _R + "ID" in e.attrib:
            s = f"<{urljoin(base, '#' + e.get(_R + 'ID'))}>"
            self.rows += [(s, TYPE, f"<{RDF}Statement>"), (s, f"<{RDF}subject>", subject), (s, f"<{RDF}predicate>", p), (s, f"<{RDF}object>", o)]


def parse_rdfxml(text: str, scope: str = "") -> list[tuple[str, str, str]]:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise RdfError(f"RDF parse error: {e}") from e
    reader = _Reader(scope)
    base, lang = root.get(_XML + "base", ""), root.get(_XML + "lang")
    for e in root if root.tag == _R + "RDF" else [root]:
        reader.node(e, base, lang)
    return reader.rows
