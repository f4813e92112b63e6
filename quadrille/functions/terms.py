"""RDF terms as encoded strings, and Columns that build and take apart them.

A term is one string: <iri>, _:label, "lexical" with @lang or ^^<datatype> (none for xsd:string), or << s p o >> with
encoded parts. Lexical forms aren't escaped: the last quote closes a literal. Equality of terms is that of strings, so
joins hash one column; NULL means unbound.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import NUMERIC_RANK, RDF, XSD


class TermError(ValueError):
    """Invalid argument: ..."""


def encode_iri(text: str) -> str:
    if not text.strip("<>") or re.search(r'[\x00-\x20<>"{}|\\^`]', text[1:-1] if text.startswith("<") else text):
        raise TermError(f"Invalid argument: not an IRI: {text}")
    return text if text.startswith("<") else f"<{text}>"


def literal(value: str, datatype: str | None = None, lang: str | None = None) -> str:
    if lang:
        return f'"{value}"@{lang}'
    return f'"{value}"' if not datatype or datatype == XSD + "string" else f'"{value}"^^<{datatype}>'


def parse_term(text: str, position: str = "object") -> str:
    """The encoded form of an API argument: bare or bracketed IRI, _:label, literal, or << >>; literals only as objects."""
    if text.startswith("<<"):
        if position == "predicate":
            raise TermError("Invalid argument: predicate must be an IRI")
        return parse_quoted(text)
    if text.startswith("_:"):
        if position == "predicate" or len(text) == 2:
            raise TermError(f"Invalid argument: {position}: {text}")
        return text
    if text.startswith('"'):
        if position != "object":
            raise TermError(f"Invalid argument: {position} can't be a literal")
        end = text.rindex('"')
        if end == 0:
            raise TermError("Invalid argument: unterminated literal")
        value, rest = text[1:end], text[end + 1 :]
        if rest.startswith("@"):
            return literal(value, lang=rest[1:])
        if rest.startswith("^^"):
            return literal(value, rest[2:].strip("<>"))
        return literal(value)
    return encode_iri(text)


def _quoted_pattern(depth: int) -> str:
    """A regular expression of an encoded quoted triple with groups for its parts; subjects nest up to `depth` deep."""
    subject = r"<(?!<)[^<>\x00-\x20]*>|_:[^\x00-\x20]+"
    plain = subject
    for _ in range(depth):
        subject = rf"{plain}|<< (?:{subject}) <[^<>\x00-\x20]*> .*? >>"
    return rf"(?s)^<< ({subject}) (<[^<>\x00-\x20]*>) (.*) >>$"


#: The object is what is left, so objects nest to any depth.
QUOTED = _quoted_pattern(4)


def split_quoted(text: str) -> tuple[str, str, str]:
    """Encoded parts of an encoded quoted triple."""
    body, parts, at = text[2:-2].strip(), [], 0
    while at < len(body):
        if body[at] == " ":
            at += 1
            continue
        start = at
        if body.startswith("<<", at):
            depth = 0
            while at < len(body):
                if body.startswith("<<", at):
                    depth, at = depth + 1, at + 2
                elif body.startswith(">>", at):
                    depth, at = depth - 1, at + 2
                    if not depth:
                        break
                else:
                    at += 1
        elif len(parts) == 2:
            at = len(body)  # the object is what is left: a literal may hold anything
        else:
            at = body.index(" ", at)
        parts.append(body[start:at].strip())
    if len(parts) != 3:
        raise TermError(f"Invalid argument: not a quoted triple: {text}")
    return parts[0], parts[1], parts[2]


def parse_quoted(text: str) -> str:
    if not text.rstrip().endswith(">>"):
        raise TermError(f"Invalid argument: not a quoted triple: {text}")
    s, p, o = split_quoted(text.strip())
    return f"<< {parse_term(s, 'subject')} {parse_term(p, 'predicate')} {parse_term(o)} >>"


def is_quoted(c: Column) -> Column:
    return F.startswith(c, F.lit("<<"))


def is_iri(c: Column) -> Column:
    return F.startswith(c, F.lit("<")) & ~is_quoted(c)


def is_blank(c: Column) -> Column:
    return F.startswith(c, F.lit("_:"))


def is_literal(c: Column) -> Column:
    return F.startswith(c, F.lit('"'))


def term_type(c: Column) -> Column:
    """iri, blank, literal, triple or unknown."""
    return F.when(is_quoted(c), "triple").when(F.startswith(c, F.lit("<")), "iri").when(is_blank(c), "blank").when(is_literal(c), "literal").otherwise("unknown")


def lexical(c: Column) -> Column:
    """What stands between the first and the last quote of a literal; NULL for other terms."""
    return F.when(is_literal(c), F.regexp_extract(c, r'(?s)^"(.*)"', 1))


def term_value(c: Column) -> Column:
    """Scalar value of a term; an error for quoted triples and unknown terms."""
    return (
        F.when(is_quoted(c), F.raise_error(F.lit("rdf_term_value: triple terms have no scalar value")).cast("string"))
        .when(F.startswith(c, F.lit("<")), F.regexp_replace(F.substr(c, F.lit(2)), ">+$", ""))
        .when(is_blank(c), F.substr(c, F.lit(3)))
        .when(is_literal(c), lexical(c))
        .when(c.isNotNull(), F.raise_error(F.lit("rdf_term_value: not a term")).cast("string"))
    )


def text_of(c: Column) -> Column:
    """STR(): the lexical form of a literal, the text of an IRI; NULL for others."""
    return F.when(is_literal(c), F.regexp_extract(c, r'(?s)^"(.*)"', 1)).when(is_iri(c), c.substr(F.lit(2), F.length(c) - 2))


def lang_of(c: Column) -> Column:
    return F.when(is_literal(c), F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1))


def datatype_of(c: Column) -> Column:
    """Bare datatype IRI of a literal."""
    dt = F.regexp_extract(c, r'"\^\^<([^">]*)>$', 1)
    return F.when(is_literal(c), F.when(dt != "", dt).when(c.rlike(r'"@[A-Za-z0-9-]+$'), F.lit(RDF + "langString")).otherwise(F.lit(XSD + "string")))


def rank_of(c: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double; NULL for what isn't numeric."""
    dt = F.regexp_extract(c, r'"\^\^<' + re.escape(XSD) + r'([A-Za-z]*)>$', 1)
    out = F.lit(None).cast("int")
    for rank in (3, 2, 1, 0):
        out = F.when(dt.isin(*[k for k, v in NUMERIC_RANK.items() if v == rank]), rank).otherwise(out)
    return out


def as_literal(c: Column, datatype: str | None = None) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"' if not datatype else f'"^^<{datatype}>'))


def to_ntriples(c: Column) -> Column:
    """An encoded term as valid N-Triples: quotes, backslashes and line ends of literals are escaped."""
    inner = lexical(c)
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        inner = F.replace(inner, F.lit(raw), F.lit(safe))
    return F.when(is_literal(c), F.concat(F.lit('"'), inner, F.regexp_extract(c, r'(?s)^".*("[^"]*)$', 1))).otherwise(c)
