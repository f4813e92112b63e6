"""SPARQL 1.1 query and update, with quoted triples, by recursive descent."""

from __future__ import annotations

from ..functions.terms import literal
from ..functions.vocab import RDF, TYPE, XSD
from ..sources.turtle import TermReader, unescape
from .algebra import BGP, Agg, Call, Exists, Extend, Filter, Graph, Join, LeftJoin, Minus, Path, Query, Quoted, Service, Union, Update, Values, Var

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class SparqlError(ValueError):
    """SPARQL parse error: ... or SPARQL evaluation error: ..."""


class Parser(TermReader):
    error, label = SparqlError, "SPARQL parse error"

    def __init__(self, text: str):
        super().__init__(text)
        self.fresh = 0

    def new(self) -> Var:
        self.fresh += 1
        return Var(f".b{self.fresh}")

    def prologue(self) -> None:
        while self.prologue_item():
            pass

    # queries

    def query(self) -> Query:
        self.prologue()
        form = self.take()[1].upper()
        if form == "SELECT":
            q = self.select()
        elif form == "ASK":
            q = self.tail(self.body(Query("ASK", None)))
        elif form == "CONSTRUCT":
            template = None
            if self.has("{"):
                self.expect("{")
                template = self.triples_block(template=True)
                self.expect("}")
            q = self.body(Query("CONSTRUCT", None))
            q.template = template if template is not None else q.where.triples if isinstance(q.where, BGP) else self.fail("a template")
            self.tail(q)
        elif form == "DESCRIBE":
            terms = []
            if not self.accept("*"):
                while self.peek()[0] in ("var", "iri", "pname"):
                    terms.append(self.var_or_iri())
            q = Query("DESCRIBE", BGP([]), describe=terms)
            if self.has("WHERE") or self.has("{") or self.has("FROM"):
                q = self.body(q)
            self.tail(q)
        else:
            self.at -= 1
            self.fail("SELECT, ASK, CONSTRUCT or DESCRIBE")
        if self.peek()[0] != "end":
            self.fail("the end")
        return q

    def select(self) -> Query:
        q = Query("SELECT", None)
        if self.accept("DISTINCT"):
            q.distinct = True
        else:
            self.accept("REDUCED")
        if not self.accept("*"):
            q.select = []
            while True:
                if self.peek()[0] == "var":
                    q.select.append((self.take()[1][1:], None))
                elif self.accept("("):
                    e = self.expression()
                    self.expect("AS")
                    q.select.append((self.variable(), e))
                    self.expect(")")
                else:
                    break
            if not q.select:
                self.fail("a projection")
        return self.tail(self.body(q))

    def body(self, q: Query) -> Query:
        while self.accept("FROM"):
            if self.accept("NAMED"):
                q.named = (q.named or []) + [f"<{self.iri()}>"]
            else:
                q.default = (q.default or []) + [f"<{self.iri()}>"]
        self.accept("WHERE")
        q.where = self.group()
        return q

    def tail(self, q: Query) -> Query:
        if self.accept("GROUP"):
            self.expect("BY")
            q.group = []
            while self.peek()[0] == "var" or self.has("(") or (self.peek()[0] in ("word", "iri", "pname") and not self.modifier()):
                if self.peek()[0] == "var":
                    q.group.append((Var(self.take()[1][1:]), None))
                elif self.accept("("):
                    e = self.expression()
                    q.group.append((e, self.variable() if self.accept("AS") else None))
                    self.expect(")")
                else:
                    q.group.append((self.primary(), None))
        if self.accept("HAVING"):
            while self.has("(") or (self.peek()[0] in ("word", "iri", "pname") and not self.modifier()):
                q.having.append(self.primary())
        if self.accept("ORDER"):
            self.expect("BY")
            while True:
                if self.has("ASC") or self.has("DESC"):
                    up = self.take()[1].upper() == "ASC"
                    q.order.append((self.primary(), up))
                elif self.peek()[0] == "var" or self.has("(") or (self.peek()[0] in ("word", "iri", "pname") and not self.modifier()):
                    q.order.append((self.primary(), True))
                else:
                    break
        while self.has("LIMIT") or self.has("OFFSET"):
            name, n = self.take()[1].upper(), int(self.take()[1])
            if name == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.accept("VALUES"):
            q.values = self.values()
        return q

    def modifier(self) -> bool:
        return any(self.has(x) for x in ("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES", "GROUP"))

    # patterns

    def group(self):
        self.expect("{")
        if self.has("SELECT"):
            self.take()
            q = self.select()
            self.expect("}")
            return q
        node, filters = BGP([]), []

        def join(left, right):
            if isinstance(left, BGP) and not left.triples:
                return right
            return Join(left, right)

        while not self.accept("}"):
            if self.accept("FILTER"):
                filters.append(self.constraint())
            elif self.accept("OPTIONAL"):
                inner, on = self.group(), None
                while isinstance(inner, Filter):  # a filter of the optional group is the join's condition
                    inner, on = inner.inner, inner.expr if on is None else Call("&&", (inner.expr, on))
                node = LeftJoin(node, inner, on)
            elif self.accept("MINUS"):
                node = Minus(node, self.group())
            elif self.accept("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                node = Extend(node, self.variable(), e)
                self.expect(")")
            elif self.accept("VALUES"):
                node = join(node, self.values())
            elif self.accept("GRAPH"):
                name = self.var_or_iri()
                node = join(node, Graph(name, self.group()))
            elif self.accept("SERVICE"):
                silent = self.accept("SILENT")
                self.var_or_iri()
                self.group()
                node = join(node, Service(silent))
            elif self.has("{"):
                parts = [self.group()]
                while self.accept("UNION"):
                    parts.append(self.group())
                node = join(node, Union(parts) if len(parts) > 1 else parts[0])
            else:
                block = BGP(self.triples_block())
                if isinstance(node, BGP):
                    node = BGP(node.triples + block.triples)
                elif isinstance(node, Join) and isinstance(node.right, BGP):
                    node = Join(node.left, BGP(node.right.triples + block.triples))
                else:
                    node = join(node, block)
            self.accept(".")
        for f in filters:
            node = Filter(f, node)
        return node

    def values(self) -> Values:
        names, many = [], self.accept("(")
        while self.peek()[0] == "var":
            names.append(self.variable())
            if not many:
                break
        if many:
            self.expect(")")
        self.expect("{")
        rows = []
        while not self.accept("}"):
            if many:
                self.expect("(")
            row = []
            for _ in names:
                row.append(None if self.accept("UNDEF") else self.ground())
            if many:
                self.expect(")")
            rows.append(row)
        return Values(names, rows)

    def ground(self) -> str:
        t = self.term(None)
        if not isinstance(t, str) or t.startswith("_:"):
            self.fail("a ground term")
        return t

    def variable(self) -> str:
        kind, v = self.take()
        if kind != "var":
            self.at -= 1
            self.fail("a variable")
        return v[1:]

    def var_or_iri(self):
        return Var(self.take()[1][1:]) if self.peek()[0] == "var" else f"<{self.iri()}>"

    def triples_block(self, template: bool = False) -> list:
        """Triples up to what can't continue them."""
        rows: list = []
        self.template = template
        while True:
            kind, v = self.peek()
            if not (kind in ("var", "iri", "pname", "bnode", "str", "long", "num") or (kind == "op" and v in ("[", "(", "<<")) or v in ("true", "false")):
                return rows
            subject = self.term(rows)
            if not (self.peek() in (("op", "."), ("op", "}")) and self.toks[self.at - 1][1] in ("]", ")")):
                self.property_list(subject, rows)
            if not self.accept("."):
                return rows

    def property_list(self, subject, rows: list) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.term(rows)
                rows.append((subject, p, o))
                if self.accept("{|"):
                    self.property_list(self.quote(subject, p, o), rows)
                    self.expect("|}")
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek()[0] == "op" and self.peek()[1] in (".", "]", "|}", "}"):
                return
            if self.peek()[0] not in ("var", "iri", "pname", "word", "op"):
                return

    def quote(self, s, p, o):
        if all(isinstance(x, str) for x in (s, p, o)):
            return f"<< {s} {p} {o} >>"
        return Quoted(s, p, o)

    def term(self, rows: list | None):
        kind, v = self.peek()
        if kind == "var":
            return Var(self.take()[1][1:])
        if kind in ("iri", "pname"):
            return f"<{self.iri()}>"
        if kind == "bnode":
            self.take()
            return v if getattr(self, "template", False) else Var("." + v[2:])
        if v == "<<" and kind == "op":
            self.take()
            s, p, o = self.term(rows), self.verb(), self.term(rows)
            self.expect(">>")
            return self.quote(s, p, o)
        if v == "[" and kind == "op" and rows is not None:
            self.take()
            self.fresh += 1
            b = f"_:n{self.fresh}" if self.template else Var(f".n{self.fresh}")
            if not self.accept("]"):
                self.property_list(b, rows)
                self.expect("]")
            return b
        if v == "(" and kind == "op" and rows is not None:
            self.take()
            items = []
            while not self.accept(")"):
                items.append(self.term(rows))
            nil = f"<{RDF}nil>"
            cells = []
            for _ in items:
                self.fresh += 1
                cells.append(f"_:n{self.fresh}" if self.template else Var(f".n{self.fresh}"))
            for i, (cell, item) in enumerate(zip(cells, items)):
                rows += [(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", cells[i + 1] if i + 1 < len(cells) else nil)]
            return cells[0] if cells else nil
        return self.literal_token()

    # paths

    def verb(self):
        if self.peek()[0] == "var":
            return Var(self.take()[1][1:])
        p = self.path()
        return p.parts[0] if p.kind == "link" else p

    def path(self) -> Path:
        parts = [self.path_sequence()]
        while self.accept("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_sequence(self) -> Path:
        parts = [self.path_step()]
        while self.accept("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_step(self) -> Path:
        if self.accept("^"):
            return Path("inv", (self.path_step(),))
        if self.accept("!"):
            many = self.accept("(")
            plain, inverse = [], []
            while not (many and self.accept(")")):
                (inverse if self.accept("^") else plain).append(self.link())
                if not many:
                    break
                self.accept("|")
            return Path("neg", (tuple(plain), tuple(inverse)))
        if self.accept("("):
            p = self.path()
            self.expect(")")
        else:
            p = Path("link", (self.link(),))
        kind, v = self.peek()
        if kind == "op" and v in ("*", "+", "?"):
            self.take()
            return Path({"*": "star", "+": "plus", "?": "opt"}[v], (p,))
        if kind == "num" and v.startswith("+"):
            self.fail("a path")
        return p

    def link(self) -> str:
        if self.peek() == ("word", "a"):
            self.take()
            return TYPE
        return f"<{self.iri()}>"

    # expressions

    def constraint(self):
        return self.primary()

    def expression(self):
        e = self.conjunction()
        while self.accept("||"):
            e = Call("||", (e, self.conjunction()))
        return e

    def conjunction(self):
        e = self.relation()
        while self.accept("&&"):
            e = Call("&&", (e, self.relation()))
        return e

    def relation(self):
        e = self.additive()
        kind, v = self.peek()
        if kind == "op" and v in ("=", "!=", "<", ">", "<=", ">="):
            self.take()
            return Call(v, (e, self.additive()))
        negated = self.has("NOT") and self.peek(1)[1].upper() == "IN"
        if negated or self.has("IN"):
            self.at += 1 + negated
            self.expect("(")
            items = []
            while not self.accept(")"):
                items.append(self.expression())
                self.accept(",")
            found = Call("IN", (e, *items))
            return Call("!", (found,)) if negated else found
        return e

    def additive(self):
        e = self.multiplicative()
        while True:
            kind, v = self.peek()
            if kind == "op" and v in "+-":
                self.take()
                e = Call(v, (e, self.multiplicative()))
            elif kind == "num" and v[0] in "+-":
                e = Call("+", (e, self.literal_token()))
            else:
                return e

    def multiplicative(self):
        e = self.unary()
        while self.peek()[0] == "op" and self.peek()[1] in ("*", "/"):
            op = self.take()[1]
            e = Call(op, (e, self.unary()))
        return e

    def unary(self):
        if self.accept("!"):
            return Call("!", (self.unary(),))
        if self.accept("-"):
            return Call("neg", (self.unary(),))
        if self.accept("+"):
            return self.unary()
        return self.primary()

    def arguments(self) -> tuple:
        self.expect("(")
        args = []
        while not self.accept(")"):
            args.append(self.expression())
            self.accept(",")
        return tuple(args)

    def primary(self):
        kind, v = self.peek()
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        if kind == "var":
            return Var(self.take()[1][1:])
        if kind == "op" and v == "<<":
            self.take()
            s, p, o = self.primary(), (Var(self.take()[1][1:]) if self.peek()[0] == "var" else self.link()), self.primary()
            self.expect(">>")
            return Call("TRIPLE", (s, p, o))
        if kind == "word" and v not in ("true", "false"):
            self.take()
            name = v.upper()
            if name in ("EXISTS", "NOT"):
                if name == "NOT":
                    self.expect("EXISTS")
                return Exists(self.group(), name == "NOT")
            if name in AGGREGATES:
                self.expect("(")
                distinct = self.accept("DISTINCT")
                arg = None if self.accept("*") else self.expression()
                separator = " "
                if self.accept(";"):
                    self.expect("SEPARATOR")
                    self.expect("=")
                    separator = unescape(self.take()[1][1:-1])
                self.expect(")")
                return Agg(name, arg, distinct, separator)
            return Call(name, self.arguments())
        if kind in ("iri", "pname"):
            i = self.iri()
            if self.has("("):
                return Call("cast", (i, *self.arguments()))
            return f"<{i}>"
        return self.literal_token()

    # updates

    def updates(self) -> list[Update]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            out.append(self.update())
            if not self.accept(";"):
                if self.peek()[0] != "end":
                    self.fail("';' or the end")
                return out

    def quads(self) -> list:
        self.expect("{")
        rows: list = []
        while not self.accept("}"):
            if self.accept("GRAPH"):
                g = self.var_or_iri()
                self.expect("{")
                rows += [(*t, g) for t in self.triples_block(template=True)]
                self.expect("}")
            else:
                rows += [(*t, None) for t in self.triples_block(template=True)]
            self.accept(".")
        self.template = False
        return rows

    def graph_ref(self) -> str:
        for word in ("DEFAULT", "NAMED", "ALL"):
            if self.accept(word):
                return word
        self.accept("GRAPH")
        return f"<{self.iri()}>"

    def update(self) -> Update:
        verb = self.peek()[1].upper()
        if verb in ("CLEAR", "DROP", "CREATE", "LOAD", "COPY", "MOVE", "ADD"):
            self.take()
            u = Update(verb.lower(), silent=self.accept("SILENT"))
            if verb == "LOAD":
                self.iri()
                if self.accept("INTO"):
                    u.target = self.graph_ref()
            elif verb in ("COPY", "MOVE", "ADD"):
                u.source = self.graph_ref()
                self.expect("TO")
                u.target = self.graph_ref()
            else:
                u.target = self.graph_ref()
            return u
        with_ = None
        if self.accept("WITH"):
            with_ = f"<{self.iri()}>"
        u = Update("modify")
        if self.accept("DELETE"):
            if self.accept("DATA"):
                return Update("delete_data", delete=self.quads())
            if self.accept("WHERE"):
                at = self.at
                u.delete = self.quads()
                self.at = at
                u.where = self.group()
                return u
            u.delete = self.quads()
        if self.accept("INSERT"):
            if self.accept("DATA"):
                return Update("insert_data", insert=self.quads())
            u.insert = self.quads()
        elif not u.delete and verb not in ("DELETE", "WITH"):
            self.fail("an update")
        while self.accept("USING"):
            if self.accept("NAMED"):
                u.using_named = (u.using_named or []) + [f"<{self.iri()}>"]
            else:
                u.using = (u.using or []) + [f"<{self.iri()}>"]
        self.expect("WHERE")
        u.where = self.group()
        if with_:
            u.delete = [(s, p, o, g or with_) for s, p, o, g in u.delete]
            u.insert = [(s, p, o, g or with_) for s, p, o, g in u.insert]
            if u.using is None and u.using_named is None:
                u.using = [with_]
        return u


def parse_query(text: str) -> Query:
    return Parser(text).query()


def parse_update(text: str) -> list[Update]:
    return Parser(text).updates()


def boolean(value: bool) -> str:
    return literal("true" if value else "false", XSD + "boolean")
