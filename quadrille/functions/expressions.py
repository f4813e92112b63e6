"""SPARQL expressions as Columns. An error is NULL, which three-valued logic treats as SPARQL does."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Agg, Call, Exists, Var
from . import terms as T
from .vocab import NUMERIC_RANK, XSD

DEC = "decimal(28,8)"
_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


@dataclass
class Value:
    """kind: term (encoded), bool, str (a simple literal's text), num (rank, dec, dbl). hint: what is known of all values of a
    term: integer, decimal (both written in one way only), dateTime, string or iri; empty where nothing is."""

    kind: str
    col: Column | None = None
    rank: Column | None = None
    dec: Column | None = None
    dbl: Column | None = None
    const: str | None = None
    hint: str = ""


#: Kinds of literals that mapped columns give, of which every value is written in one way: rank, and what the number is cast to.
CANONICAL = {"integer": (0, "decimal(28,0)"), "decimal": (1, "decimal(28,2)")}


def term(c: Column, const: str | None = None, hint: str = "") -> Value:
    return Value("term", c, const=const, hint=hint)


def inner(c: Column, hint: str) -> Column:
    """Lexical form of a literal of a known kind, by position."""
    tail = 1 if hint == "string" else len(f'"^^<{XSD}{hint}>')
    return F.substring(c, F.lit(2), F.length(c) - (tail + 1))


def bare(c: Column, hint: str) -> Column:
    """Text of a string or IRI of known kind, without its marks: their order is that of terms."""
    return inner(c, hint) if hint == "string" else F.substring(c, F.lit(2), F.length(c) - 2)


def written(number: Column, hint: str) -> Column:
    return T.as_literal(number.cast(CANONICAL[hint][1]), XSD + hint)


def string(c: Column) -> Value:
    return Value("str", c)


def truth(c: Column) -> Value:
    return Value("bool", c)


def integer(c: Column) -> Value:
    return Value("num", rank=F.when(c.isNotNull(), 0), dec=c.cast(DEC), dbl=c.cast("double"))


def to_term(v: Value) -> Column:
    if v.kind == "term":
        return v.col
    if v.kind == "bool":
        return T.as_literal(v.col, XSD + "boolean")
    if v.kind == "str":
        return T.as_literal(v.col)
    plain = F.regexp_replace(F.regexp_replace(v.dec.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(v.rank == 0, T.as_literal(v.dec.cast("decimal(28,0)"), XSD + "integer")).when(v.rank == 1, T.as_literal(plain, XSD + "decimal"))
        .when(v.rank == 2, T.as_literal(v.dbl, XSD + "float")).when(v.rank == 3, T.as_literal(v.dbl, XSD + "double"))
    )


def to_text(v: Value) -> Column:
    """STR() of a value."""
    return v.col if v.kind == "str" else T.text_of(to_term(v))


def string_arg(v: Value) -> Column:
    """Text of a string literal, plain or with a language; NULL for others."""
    if v.kind == "str":
        return v.col
    if v.hint == "string":
        return inner(v.col, "string")
    t = to_term(v)
    return F.when(~t.rlike(r'"\^\^<[^">]*>$'), T.lexical(t))


def _double(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double")).when(text == "INF", F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).when(text == "NaN", F.lit(float("nan")))


def to_num(v: Value) -> Value:
    if v.kind == "num":
        return v
    if v.hint in CANONICAL:
        dec = inner(v.col, v.hint).try_cast(DEC)
        return Value("num", rank=F.when(dec.isNotNull(), CANONICAL[v.hint][0]), dec=dec, dbl=dec.cast("double"))
    if v.kind != "term" or v.hint:
        none = F.lit(None)
        return Value("num", rank=none.cast("int"), dec=none.cast(DEC), dbl=none.cast("double"))
    lex, rank = T.lexical(v.col), T.rank_of(v.col)
    dbl = F.when(rank.isNotNull(), _double(lex))
    dec = F.when((rank <= 1) & lex.rlike(_NUMBER), lex.try_cast(DEC))
    return Value("num", rank=F.when(dbl.isNotNull(), rank), dec=dec, dbl=dbl)


def to_bool(v: Value) -> Column:
    """Effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind == "str":
        return v.col != ""
    if v.kind == "num":
        return (v.dbl != 0) & ~F.isnan(v.dbl)
    dt, lex = T.datatype_of(v.col), T.lexical(v.col)
    n = to_num(v)
    return F.when(dt == XSD + "boolean", lex.isin("true", "1")).when((dt == XSD + "string") | v.col.rlike(r'"@[A-Za-z0-9-]+$'), lex != "").when(T.rank_of(v.col).isNotNull(), F.coalesce((n.dbl != 0) & ~F.isnan(n.dbl), F.lit(False)))


def _numeric(op: Callable, a: Value, b: Value) -> Value:
    x, y = to_num(a), to_num(b)
    rank = F.greatest(x.rank, y.rank)
    exact = (x.rank <= 1) & (y.rank <= 1)
    return Value("num", rank=F.when(x.rank.isNotNull() & y.rank.isNotNull(), rank), dec=F.when(exact, op(x.dec, y.dec).cast(DEC)), dbl=op(x.dbl, y.dbl))


def _kind_of(v: Value) -> str | None:
    """What a constant is known to be."""
    if v.kind != "term":
        return v.kind
    if v.hint:
        return "num" if v.hint in CANONICAL else {"dateTime": "time", "string": "str", "iri": "iri"}[v.hint]
    if v.const is None:
        return None
    if not v.const.startswith('"'):
        return "iri"
    m = re.search(r'"(?:\^\^<([^">]*)>|@[\w-]+)?$', v.const)
    if m[1] and m[1].startswith(XSD):
        name = m[1][len(XSD) :]
        return "num" if name in NUMERIC_RANK else "bool" if name == "boolean" else "time" if name in ("dateTime", "date") else None
    return "str" if m[0] == '"' else None


def _exact(v: Value):
    """The number of a constant integer or decimal that fits the exact type; else None."""
    m = re.fullmatch(rf'"([+-]?[0-9]{{1,18}}(?:\.[0-9]{{1,8}})?)"\^\^<{re.escape(XSD)}(?:integer|decimal)>', v.const or "")
    return Decimal(m[1]) if m else None


def compare(op: str, a: Value, b: Value) -> Column:
    f = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    known = _kind_of(a) or _kind_of(b)
    if known == "iri" and op == "=":
        return to_term(a) == to_term(b)
    if known == "num" and all(v.hint in CANONICAL or _exact(v) is not None for v in (a, b)):
        x, y = (F.lit(_exact(v)).cast(DEC) if _exact(v) is not None else to_num(v).dec for v in (a, b))
        return f(x, y)
    if known == "str" and all(_kind_of(v) == "str" for v in (a, b)):
        x, y = (v.col if v.kind == "str" else F.lit(v.const[1:-1]) if v.const is not None else inner(v.col, "string") for v in (a, b))
        return f(x, y)
    out = F.lit(None).cast("boolean")
    same = to_term(a) == to_term(b)
    if op == "=":
        out = same
    if known in (None, "bool"):
        x, y = (v.col if v.kind == "bool" else F.when(T.datatype_of(to_term(v)) == XSD + "boolean", T.lexical(to_term(v)).isin("true", "1")) for v in (a, b))
        out = F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(out)
    if known in (None, "time"):
        times = [_time(v).try_cast("timestamp") for v in (a, b)]
        out = F.when(times[0].isNotNull() & times[1].isNotNull(), f(*times)).otherwise(out)
    if known in (None, "str"):
        x, y = (v.col if v.kind == "str" else F.when(T.datatype_of(to_term(v)) == XSD + "string", T.lexical(to_term(v))) for v in (a, b))
        out = F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(out)
    if known in (None, "num"):
        x, y = to_num(a), to_num(b)
        exact = F.when((x.rank <= 1) & (y.rank <= 1), f(x.dec, y.dec)).otherwise(f(x.dbl, y.dbl) & ~F.isnan(x.dbl) & ~F.isnan(y.dbl))
        out = F.when(x.rank.isNotNull() & y.rank.isNotNull(), exact).otherwise(out)
    return F.when(to_term(a).isNotNull() & to_term(b).isNotNull(), out)


def order_keys(v: Value) -> list[Column]:
    """Unbound < blank < IRI < literal < triple; numbers by value, before other literals; then text."""
    if v.hint in CANONICAL:
        return [to_num(v).dec]
    c = to_term(v)
    if v.hint in ("string", "iri"):
        return [bare(c, v.hint)]
    kind = F.when(c.isNull(), 0).when(T.is_blank(c), 1).when(T.is_quoted(c), 4).when(T.is_iri(c), 2).otherwise(3)
    n = to_num(term(c))  # doubles first, then exact values, which tell apart what doubles can't
    return [kind, F.when(n.dbl.isNotNull(), 0).otherwise(1), F.coalesce(n.dec.cast("double"), n.dbl), n.dec, F.coalesce(T.text_of(c), c)]


def _rebuild(source: Value, text: Column) -> Value:
    """A string result with the language of its source."""
    if source.kind == "str":
        return string(text)
    tag = F.regexp_extract(to_term(source), r'"(@[A-Za-z0-9-]+)$', 1)
    return term(F.concat(F.lit('"'), text, F.lit('"'), tag))


def _round(v: Value, dec: Callable, dbl: Callable) -> Value:
    n = to_num(v)
    return Value("num", rank=n.rank, dec=dec(n.dec).cast(DEC), dbl=dbl(n.dbl))


def _regex(pattern: Column, flags: Column | None) -> Column:
    return pattern if flags is None else F.concat(F.lit("(?"), flags, F.lit(")"), pattern)


def _time(v: Value) -> Column:
    if v.hint:
        return inner(v.col, v.hint) if v.hint == "dateTime" else F.lit(None).cast("string")
    return F.when(T.datatype_of(to_term(v)).isin(XSD + "dateTime", XSD + "date"), T.lexical(to_term(v)))


def _cast(name: str, v: Value) -> Value:
    text = F.trim(to_text(v))
    if name == "string":
        return string(to_text(v))
    if name == "boolean":
        n = to_num(v)
        return truth(F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).when(n.dbl.isNotNull(), n.dbl != 0))
    if name in ("double", "float"):
        d = F.coalesce(_double(text), F.when(text == "true", 1.0).when(text == "false", 0.0))
        return Value("num", rank=F.when(d.isNotNull(), 3 if name == "double" else 2), dec=F.lit(None).cast(DEC), dbl=d)
    if name in ("decimal", "integer"):
        d = F.coalesce(F.when(text.rlike(_NUMBER if v.kind == "num" else r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast(DEC)), F.when(text == "true", F.lit(1)).when(text == "false", F.lit(0)).cast(DEC))
        if name == "integer":
            d = F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast(DEC)
        return Value("num", rank=F.when(d.isNotNull(), 0 if name == "integer" else 1), dec=d, dbl=d.cast("double"))
    if name in ("dateTime", "date"):
        return term(F.when(text.try_cast("timestamp").isNotNull(), T.as_literal(text, XSD + name)))
    raise KeyError(name)


class Compiler:
    """Compiles expressions given `column(name)` for variables and hooks for aggregates and EXISTS."""

    def __init__(self, column: Callable[[str], Column | None], aggregate: Callable | None = None, exists: Callable | None = None, error: type[Exception] = ValueError, base: str = "", kinds: dict | None = None):
        self.column, self.aggregate, self.exists, self.error, self.kinds = column, aggregate, exists, error, kinds or {}

    def __call__(self, e) -> Value:
        if isinstance(e, Var):
            c = self.column(e.name)
            return term(F.lit(None).cast("string")) if c is None else term(c, hint=self.kinds.get(e.name, ""))
        if isinstance(e, str):
            return term(F.lit(e), e)
        if isinstance(e, Agg):
            if self.aggregate is None:
                raise self.error("SPARQL parse error: an aggregate stands outside of a group's projection")
            return self.aggregate(e)
        if isinstance(e, Exists):
            return truth(self.exists(e))
        name, args = e.name, e.args
        method = getattr(self, f"_{name.lower()}", None) if name.isidentifier() else None
        if name in ("||", "&&"):
            a, b = (to_bool(self(x)) for x in args)
            return truth(a | b if name == "||" else a & b)
        if name == "!":
            return truth(~to_bool(self(args[0])))
        if name in ("=", "<", ">", "<=", ">="):
            return truth(compare(name, self(args[0]), self(args[1])))
        if name == "!=":
            return truth(~compare("=", self(args[0]), self(args[1])))
        if name == "IN":
            left = self(args[0])
            out = F.lit(False)
            for x in args[1:]:
                out = out | compare("=", left, self(x))
            return truth(out)
        if name in ("+", "-", "*"):
            return _numeric({"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[name], self(args[0]), self(args[1]))
        if name == "/":
            out = _numeric(lambda x, y: F.try_divide(x, y), self(args[0]), self(args[1]))
            rank = F.greatest(out.rank, F.lit(1))  # integers divide to a decimal
            return Value("num", rank=F.when(out.rank.isNotNull() & ((rank > 1) | out.dec.isNotNull()), rank), dec=out.dec, dbl=out.dbl)
        if name == "neg":
            return _round(self(args[0]), lambda x: -x, lambda x: -x)
        if name == "cast":
            target = args[0]
            if target.startswith(XSD):
                try:
                    return _cast(target[len(XSD) :], self(args[1]))
                except KeyError:
                    pass
            raise self.error(f"SPARQL evaluation error: unknown function <{target}>")
        if method is None:
            raise self.error(f"SPARQL parse error: unknown function {name}")
        return method(*args)

    # logic

    def _if(self, c, a, b):
        x, y = to_term(self(a)), to_term(self(b))
        test = to_bool(self(c))
        return term(F.when(test, x).when(~test, y))

    def _coalesce(self, *args):
        return term(F.coalesce(*[to_term(self(a)) for a in args]))

    def _bound(self, v):
        return truth(self(v).col.isNotNull())

    def _sameterm(self, a, b):
        return truth(to_term(self(a)) == to_term(self(b)))

    # numbers

    def _abs(self, a):
        return _round(self(a), F.abs, F.abs)

    def _ceil(self, a):
        return _round(self(a), F.ceil, lambda x: F.ceil(x).cast("double"))

    def _floor(self, a):
        return _round(self(a), F.floor, lambda x: F.floor(x).cast("double"))

    def _round(self, a):
        return _round(self(a), lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")), lambda x: F.floor(x + 0.5).cast("double"))

    def _rand(self):
        return Value("num", rank=F.lit(3), dec=F.lit(None).cast(DEC), dbl=F.rand())

    # terms

    def _isiri(self, a):
        return truth(T.is_iri(to_term(self(a))))

    _isuri = _isiri

    def _isblank(self, a):
        return truth(T.is_blank(to_term(self(a))))

    def _isliteral(self, a):
        return truth(T.is_literal(to_term(self(a))))

    def _isnumeric(self, a):
        t = to_term(self(a))
        return truth(F.when(t.isNotNull(), to_num(term(t)).dbl.isNotNull()))

    def _istriple(self, a):
        return truth(T.is_quoted(to_term(self(a))))

    def _str(self, a):
        return string(to_text(self(a)))

    def _lang(self, a):
        return string(T.lang_of(to_term(self(a))))

    def _datatype(self, a):
        dt = T.datatype_of(to_term(self(a)))
        return term(F.concat(F.lit("<"), dt, F.lit(">")))

    def _iri(self, a):
        v = to_text(self(a))
        return term(F.concat(F.lit("<"), v, F.lit(">")))

    _uri = _iri

    def _bnode(self, a=None):
        return term(F.concat(F.lit("_:"), F.replace(F.uuid(), F.lit("-"), F.lit("")) if a is None else F.concat(F.lit("l"), F.md5(string_arg(self(a))))))

    def _strdt(self, a, dt):
        t = to_term(self(dt))
        return term(F.when(t == f"<{XSD}string>", T.as_literal(string_arg(self(a)))).otherwise(F.concat(F.lit('"'), string_arg(self(a)), F.lit('"^^'), t)))

    def _strlang(self, a, tag):
        return term(F.concat(F.lit('"'), string_arg(self(a)), F.lit('"@'), F.lower(string_arg(self(tag)))))

    def _uuid(self):
        return term(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))

    def _struuid(self):
        return string(F.uuid())

    def _triple(self, s, p, o):
        return term(F.concat(F.lit("<< "), to_term(self(s)), F.lit(" "), to_term(self(p)), F.lit(" "), to_term(self(o)), F.lit(" >>")))

    def _part(self, a, name):
        return term(quoted_parts(to_term(self(a)))[name])

    def _subject(self, a):
        return self._part(a, "s")

    def _predicate(self, a):
        return self._part(a, "p")

    def _object(self, a):
        return self._part(a, "o")

    # strings

    def _strlen(self, a):
        return integer(F.length(string_arg(self(a))))

    def _substr(self, a, start, size=None):
        v = self(a)
        text, at = string_arg(v), to_num(self(start)).dbl
        begin = F.floor(at + 0.5)
        end = F.lit(float(1 << 30)) if size is None else begin + F.floor(to_num(self(size)).dbl + 0.5)
        first = F.greatest(begin, F.lit(1))
        return _rebuild(v, F.substr(text, first.cast("int"), F.greatest(end - first, F.lit(0)).cast("int")))

    def _substring(self, *args):
        return self._substr(*args)

    def _ucase(self, a):
        v = self(a)
        return _rebuild(v, F.upper(string_arg(v)))

    def _lcase(self, a):
        v = self(a)
        return _rebuild(v, F.lower(string_arg(v)))

    def _strstarts(self, a, b):
        return truth(F.startswith(string_arg(self(a)), string_arg(self(b))))

    def _strends(self, a, b):
        return truth(F.endswith(string_arg(self(a)), string_arg(self(b))))

    def _contains(self, a, b):
        return truth(F.contains(string_arg(self(a)), string_arg(self(b))))

    def _strbefore(self, a, b):
        v = self(a)
        text, cut = string_arg(v), string_arg(self(b))
        at = F.position(cut, text)
        return term(F.when(at > 0, to_term(_rebuild(v, F.substr(text, F.lit(1), at - 1)))).when(at == 0, F.lit('""')))

    def _strafter(self, a, b):
        v = self(a)
        text, cut = string_arg(v), string_arg(self(b))
        at = F.position(cut, text)
        return term(F.when(at > 0, to_term(_rebuild(v, F.substr(text, at + F.length(cut), F.length(text))))).when(at == 0, F.lit('""')))

    def _encode_for_uri(self, a):
        c = F.url_encode(string_arg(self(a)))
        for x, y in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            c = F.replace(c, F.lit(x), F.lit(y))
        return string(c)

    def _concat(self, *args):
        values = [self(a) for a in args]
        text = F.concat(*[string_arg(v) for v in values]) if values else F.lit("")
        if not values or any(v.kind == "str" or (v.const and not re.search(r'"@[\w-]+$', v.const)) for v in values):
            return string(text)
        tags = [F.regexp_extract(to_term(v), r'"(@[A-Za-z0-9-]+)$', 1) for v in values]
        same = F.lit(True)
        for t in tags[1:]:
            same = same & (t == tags[0])
        return term(F.concat(F.lit('"'), text, F.lit('"'), F.when(same, tags[0]).otherwise("")))

    def _langmatches(self, a, b):
        tag, want = F.lower(string_arg(self(a))), F.lower(string_arg(self(b)))
        return truth(F.when(want == "*", tag != "").otherwise((tag == want) | F.startswith(tag, F.concat(want, F.lit("-")))))

    def _regex(self, a, pattern, flags=None):
        return truth(F.rlike(string_arg(self(a)), _regex(string_arg(self(pattern)), None if flags is None else string_arg(self(flags)))))

    def _replace(self, a, pattern, by, flags=None):
        v = self(a)
        return _rebuild(v, F.regexp_replace(string_arg(v), _regex(string_arg(self(pattern)), None if flags is None else string_arg(self(flags))), string_arg(self(by))))

    # time: the parts as written, without a change of zone

    def _now(self):
        return term(T.as_literal(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), XSD + "dateTime"))

    def _field(self, a, pattern):
        return integer(F.regexp_extract(_time(self(a)), pattern, 1).try_cast("int"))

    def _year(self, a):
        return self._field(a, r"^(-?[0-9]{4,})-")

    def _month(self, a):
        return self._field(a, r"^-?[0-9]{4,}-([0-9]{2})")

    def _day(self, a):
        return self._field(a, r"^-?[0-9]{4,}-[0-9]{2}-([0-9]{2})")

    def _hours(self, a):
        return self._field(a, r"T([0-9]{2}):")

    def _minutes(self, a):
        return self._field(a, r"T[0-9]{2}:([0-9]{2})")

    def _seconds(self, a):
        d = F.regexp_extract(_time(self(a)), r"T[0-9]{2}:[0-9]{2}:([0-9]{2}(?:\.[0-9]+)?)", 1).try_cast(DEC)
        return Value("num", rank=F.when(d.isNotNull(), 1), dec=d, dbl=d.cast("double"))

    def _tz(self, a):
        return string(F.regexp_extract(_time(self(a)), r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1))

    def _timezone(self, a):
        z = to_text(self._tz(a))
        h, m = F.regexp_extract(z, "([0-9]{2}):", 1).try_cast("int"), F.regexp_extract(z, ":([0-9]{2})", 1).try_cast("int")
        span = F.concat(F.when(F.startswith(z, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
        return term(T.as_literal(F.when((z == "Z") | ((h == 0) & (m == 0)), "PT0S").when(z != "", span), XSD + "dayTimeDuration"))

    # hashes

    def _md5(self, a):
        return string(F.md5(string_arg(self(a))))

    def _sha1(self, a):
        return string(F.sha1(string_arg(self(a))))

    def _sha256(self, a):
        return string(F.sha2(string_arg(self(a)), 256))

    def _sha384(self, a):
        return string(F.sha2(string_arg(self(a)), 384))

    def _sha512(self, a):
        return string(F.sha2(string_arg(self(a)), 512))


def quoted_parts(c: Column) -> Column:
    """struct(s, p, o) of an encoded quoted triple; NULL for other terms."""
    return F.struct(*[F.when(T.is_quoted(c), F.regexp_extract(c, T.QUOTED, i)).alias(n) for i, n in enumerate("spo", 1)])
