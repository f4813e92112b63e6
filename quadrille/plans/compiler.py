"""SPARQL algebra to DataFrames.

A solution is a DataFrame with one nullable string column per variable and the set of variables that may be unbound.
Joins on variables that are surely bound are equi-joins, which Catalyst plans; only the others test compatibility.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import CANONICAL, DEC, Compiler, Value, bare, integer, order_keys, quoted_parts, string, string_arg, term, to_bool, to_num, to_term, written
from ..functions import terms as T
from ..functions.terms import is_blank, is_iri, is_literal
from ..operators import closure, durable
from .algebra import BGP, Agg, Call, Exists, Extend, Filter, Graph, Join, LeftJoin, Minus, Path, Query, Quoted, Service, Union, Values, Var, variables
from .parser import SparqlError


class QuadTable:
    """A source of quads: a DataFrame (s, p, o, g) of encoded terms; g is NULL in the default graph."""

    def __init__(self, quads: DataFrame):
        self.quads = quads
        self.spark = quads.sparkSession

    def scan(self, predicate: str | None = None) -> DataFrame:
        return self.quads if predicate is None else self.quads.where(F.col("p") == predicate)


@dataclass
class Mapped:
    """How values of one position stand in a row: the encoded term, what is known of all of them (a kind of literal, or
    `iri`), and the row's own column where equality with a constant can be tested on it."""

    term: Column
    kind: str
    column: str | None = None
    prefix: str = ""

    def same(self, constant: str) -> Column | None:
        """Equality with a constant on the row's own column, which the scan can push down; None where it has none."""
        if self.column is None:
            return None
        if self.kind == "iri":
            key = constant[len(self.prefix) : -1] if constant.startswith(self.prefix) else ""
            return F.col(self.column) == int(key) if key.isdigit() and len(key) < 18 else F.lit(False)
        return F.col(self.column) == constant[1:-1] if constant.endswith('"') and constant.startswith('"') else F.lit(False)


@dataclass
class RowMap:
    """A table each of whose rows is one subject: its term, and predicate -> object; null values give no triple."""

    df: DataFrame
    subject: Mapped
    objects: dict[str, Mapped]
    required: dict[str, str]  # predicate -> column that mustn't be null


class MappedTables:
    """Quads of the default graph that stand as rows of tables. A subject is one row of one table, so patterns that share
    their subject are one projection of it; only the columns that they name are read."""

    def __init__(self, spark: SparkSession, maps: list[RowMap]):
        self.spark, self.maps = spark, maps

    def predicates(self) -> list[str]:
        return list(dict.fromkeys(p for m in self.maps for p in m.objects))

    def scan(self, predicate: str | None = None) -> DataFrame:
        parts = []
        for m in self.maps:
            if predicate is None:  # one scan for all predicates
                pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.term.alias("o")) for p, o in m.objects.items()])
                parts.append(m.df.select(m.subject.term.alias("s"), F.explode(pairs).alias("_po")).select("s", "_po.p", "_po.o").where("o IS NOT NULL"))
            elif predicate in m.objects:
                parts.append(self.rows(m, [predicate]).select(m.subject.term.alias("s"), F.lit(predicate).alias("p"), m.objects[predicate].term.alias("o")))
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string, g string")
        return reduce(DataFrame.union, parts).withColumn("g", F.lit(None).cast("string"))

    @staticmethod
    def rows(m: RowMap, predicates: list[str]) -> DataFrame:
        df = m.df
        for c in dict.fromkeys(m.required[p] for p in predicates if p in m.required):
            df = df.where(F.col(c).isNotNull())
        return df

    def star(self, subject, pairs: list[tuple]) -> tuple[DataFrame, list[str]] | None:
        """(rows with columns s, o0, o1, ..., what is known of each column) of patterns that share their subject; a pair is
        (predicate, object). None where no table has all the predicates."""
        parts, kinds = [], None
        for m in self.maps:
            if not all(p in m.objects for p, _ in pairs):
                continue
            df = self.rows(m, [p for p, _ in pairs])
            tests = [(m.subject, subject), *((m.objects[p], o) for p, o in pairs)]
            for at, t in tests:
                test = at.same(t) if isinstance(t, str) else None
                if test is not None:
                    df = df.where(test)
            own = [at.kind for at, _ in tests]
            kinds = own if kinds is None else [a if a == b else "" for a, b in zip(kinds, own)]
            parts.append(df.select(*[at.term.alias("s" if i == 0 else f"o{i - 1}") for i, (at, _) in enumerate(tests)]))
        return (reduce(DataFrame.union, parts), kinds) if parts else None


@dataclass
class Solution:
    """kinds: what is known of all values of a variable, by name."""

    df: DataFrame
    names: list
    maybe: set
    kinds: dict = field(default_factory=dict)


def col_name(name: str) -> str:
    return "v_" + name.replace(".", "_b_")


def _c(name: str) -> Column:
    return F.col(col_name(name))


def compatible(a: Column, b: Column, sure: bool) -> Column:
    return a == b if sure else a.isNull() | b.isNull() | (a == b)


class QueryCompiler:
    def __init__(self, source, default: list | None = None, named: list | None = None):
        self.source, self.spark = source, source.spark
        self.default, self.named = default, named
        self.graph = None  # what GRAPH says: None, an IRI or a Var

    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(F.lit(1).alias("_unit")), [], set())

    # scans

    def quads(self, predicate: str | None) -> DataFrame:
        """(s, p, o, g) of the active graph; g matters only under GRAPH ?g."""
        df = self.source.scan(predicate)
        if self.graph is None:
            if self.default is None and self.named is None:
                return df.where("g IS NULL")
            if not self.default:
                return df.where(F.lit(False))
            df = df.where(F.col("g").isin(*self.default))
            return df if len(self.default) == 1 else df.select("s", "p", "o").distinct().withColumn("g", F.lit(None).cast("string"))
        df = df.where("g IS NOT NULL")
        if self.named is not None or self.default is not None:
            df = df.where(F.col("g").isin(*self.named)) if self.named else df.where(F.lit(False))
        return df.where(F.col("g") == self.graph) if isinstance(self.graph, str) else df

    def pattern(self, s, p, o) -> Solution:
        if isinstance(p, Path):
            return self.path_pattern(s, p, o)
        df = self.quads(p if isinstance(p, str) else None)
        return self.bind(df, [("s", s), ("p", None if isinstance(p, str) else p), ("o", o)])

    def star(self, subject, triples: list) -> Solution | None:
        """Patterns with one subject over mapped tables, as one projection; None where that isn't what the source is."""
        if not isinstance(self.source, MappedTables) or self.graph is not None or self.default is not None or self.named is not None:
            return None
        if isinstance(subject, Quoted) or not all(isinstance(p, str) and not isinstance(o, Quoted) for _, p, o in triples):
            return None
        found = self.source.star(subject, [(p, o) for _, p, o in triples])
        if found is None:
            return Solution(self.bind(self.source.scan("<>"), [("s", subject), *(("o", o) for _, _, o in triples)]).df, *self.names_of(subject, triples)) if isinstance(subject, Var) else None
        df, kinds = found
        positions = [("s", subject), *((f"o{i}", o) for i, (_, _, o) in enumerate(triples))]
        out = self.bind(df, positions)
        out.kinds = {t.name: k for (_, t), k in zip(reversed(positions), reversed(kinds)) if isinstance(t, Var) and k}
        return out

    @staticmethod
    def names_of(subject, triples: list) -> tuple[list, set]:
        return list(dict.fromkeys(t.name for t in (subject, *(o for _, _, o in triples)) if isinstance(t, Var))), set()

    def bind(self, df: DataFrame, positions: list) -> Solution:
        """Match columns with constants, variables and quoted patterns."""
        todo = [(F.col(c), t) for c, t in positions if t is not None]
        if isinstance(self.graph, Var):
            todo.append((F.col("g"), self.graph))
        found: dict[str, Column] = {}
        tests: list[Column] = []
        quoted: list = []
        for c, t in todo:
            if isinstance(t, Var):
                if t.name in found:
                    tests.append(found[t.name] == c)
                else:
                    found[t.name] = c
            elif isinstance(t, Quoted):
                quoted.append((c, t))
            else:
                tests.append(c == t)
        for test in tests:
            df = df.where(test)
        n = 0
        while quoted:  # take quoted triples apart, outermost first
            c, t = quoted.pop()
            n += 1
            df = df.where(F.startswith(c, F.lit("<<"))).withColumn(f"_q{n}", quoted_parts(c))
            for part, x in zip(("s", "p", "o"), (t.s, t.p, t.o)):
                pc = F.col(f"_q{n}.{part}")
                if isinstance(x, Quoted):
                    quoted.append((pc, x))
                elif isinstance(x, Var):
                    if x.name in found:
                        df = df.where(found[x.name] == pc)
                    else:
                        found[x.name] = pc
                else:
                    df = df.where(pc == x)
        out = df.select(*[c.alias(col_name(x)) for x, c in found.items()]) if found else df.select(F.lit(1).alias("_unit"))
        return Solution(out, list(found), set())

    # paths

    def path_pattern(self, s, p: Path, o) -> Solution:
        group = isinstance(self.graph, Var)
        if p.kind in ("star", "plus") and isinstance(s, str) and not group:
            edges = self.path_pairs(p.parts[0]).select("s", "o")
            seeds = self.spark.range(1).select(F.lit(s).alias("n"))
            reach = closure.reachable(seeds, edges)
            if p.kind == "star":
                reach = reach.union(seeds).distinct()
            return self.bind(reach.select(F.lit(s).alias("s"), F.col("n").alias("o")), [("o", o)])
        if p.kind in ("star", "plus") and isinstance(o, str) and not group:
            return self.path_pattern(o, Path(p.kind, (Path("inv", p.parts),)), s)
        pairs = self.path_pairs(p, [x for x in (s, o) if isinstance(x, str)])
        return self.bind(pairs, [("s", s), ("o", o)])

    def path_pairs(self, p: Path, constants: list = ()) -> DataFrame:
        """(s, o, g) pairs that a path joins; bags for sequences and alternatives, sets for closures."""
        if p.kind == "link":
            return self.quads(p.parts[0]).select("s", "o", "g")
        if p.kind == "inv":
            return self.path_pairs(p.parts[0], constants).selectExpr("o AS s", "s AS o", "g")
        if p.kind == "seq":
            out = self.path_pairs(p.parts[0])
            for nxt in p.parts[1:]:
                step = self.path_pairs(nxt).selectExpr("s AS o", "o AS _far", "g AS _g")
                out = out.join(step, "o").where(F.col("g").eqNullSafe(F.col("_g"))).selectExpr("s", "_far AS o", "g") if isinstance(self.graph, Var) else out.join(step, "o").selectExpr("s", "_far AS o", "g")
            return out
        if p.kind == "alt":
            return reduce(DataFrame.union, [self.path_pairs(x, constants) for x in p.parts])
        if p.kind == "neg":
            plain, inverse = p.parts
            parts = []
            if plain or not inverse:
                df = self.quads(None)
                parts.append((df.where(~F.col("p").isin(*plain)) if plain else df).select("s", "o", "g"))
            if inverse:
                parts.append(self.quads(None).where(~F.col("p").isin(*inverse)).selectExpr("o AS s", "s AS o", "g"))
            return reduce(DataFrame.union, parts)
        step = self.path_pairs(p.parts[0]).distinct()
        if p.kind != "opt":
            if isinstance(self.graph, Var):
                step = closure.transitive(step, ["g"])
            else:
                step = closure.transitive(step.select("s", "o")).withColumn("g", F.lit(None).cast("string"))
        if p.kind == "plus":
            return step.select("s", "o", "g")
        nodes = self.quads(None)
        nodes = nodes.selectExpr("s AS n", "g").union(nodes.selectExpr("o AS n", "g"))
        if constants:
            nodes = nodes.union(self.spark.createDataFrame([(c,) for c in constants], "n string").withColumn("g", F.lit(None).cast("string")))
        if not isinstance(self.graph, Var):
            nodes, step = nodes.select("n").withColumn("g", F.lit(None).cast("string")), step.select("s", "o", F.lit(None).cast("string").alias("g"))
        return step.select("s", "o", "g").union(nodes.selectExpr("n AS s", "n AS o", "g")).distinct()

    # patterns

    def compile(self, node) -> Solution:
        return getattr(self, "on_" + type(node).__name__.lower())(node)

    def on_bgp(self, node: BGP) -> Solution:
        if not node.triples:
            if isinstance(self.graph, Var):
                return self.bind(self.quads(None).select("g").distinct(), [])
            return self.unit()
        groups: dict = {}  # patterns that share their subject go together where the source can take them so
        for t in node.triples:
            groups.setdefault(t[0] if isinstance(t[0], (Var, str)) and isinstance(t[1], str) and not isinstance(t[2], Quoted) else ("alone", len(groups)), []).append(t)
        left: list = []
        for subject, own in groups.items():
            made = self.star(subject, own) if not isinstance(subject, tuple) else None
            left.extend([(own, made)] if made is not None else [([t], None) for t in own])
        bound, out = set(), None

        def names(triples):
            return set(variables(BGP(triples))) | {x.name for t in triples for x in t if isinstance(x, Var)}

        while left:  # most constants first, then what shares variables with what is there
            def cost(item):
                triples = item[0]
                own = names(triples)
                weight = sum(-2 * isinstance(t[0], str) - 2 * isinstance(t[2], str) - sum(isinstance(x, str) for x in t) for t in triples)
                return (bool(bound) and not own & bound, weight, isinstance(triples[0][1], Path))

            best = min(left, key=cost)
            left.remove(best)
            part = best[1] if best[1] is not None else self.pattern(*best[0][0])
            out = part if out is None else self.join(out, part)
            bound |= names(best[0])
        return out

    def join(self, a: Solution, b: Solution, how: str = "inner", on=None) -> Solution:
        shared = [x for x in a.names if x in b.names]
        names = a.names + [x for x in b.names if x not in a.names]
        maybe = set(a.maybe) | set(b.maybe)
        if how == "inner":
            maybe = {x for x in maybe if not ((x in a.names and x not in a.maybe) or (x in b.names and x not in b.maybe))}
        else:
            maybe = {x for x in names if (x in a.maybe or x not in a.names)}
        kinds = {**b.kinds, **a.kinds}
        for x in shared:  # equal values are of the kind of either side; where one may be unbound, only if both agree
            if (x in a.maybe or x in b.maybe) and a.kinds.get(x) != b.kinds.get(x):
                kinds.pop(x, None)
        if not a.names and how == "inner" and "_unit" in a.df.columns and a.df.columns == ["_unit"] and not b.names:
            return Solution(a.df.crossJoin(b.df.select(F.lit(1).alias("_u2"))).select("_unit"), [], set())
        if on is None and shared and not any(x in a.maybe or x in b.maybe for x in shared):
            keys = [col_name(x) for x in shared]
            df = a.df.drop("_unit").join(b.df.drop("_unit"), keys, how)
            return Solution(df.select(*[_c(x) for x in names]), names, maybe, kinds)
        if how == "inner" and on is None and 1 <= sum((x in a.maybe) + (x in b.maybe) for x in shared) <= 3:
            return Solution(self.split_join(a, b, shared, names), names, maybe, kinds)
        right = b.df.select(*[_c(x).alias("r_" + col_name(x)) for x in b.names], F.lit(1).alias("_r"))
        cond = F.lit(True)
        for x in shared:
            cond = cond & compatible(_c(x), F.col("r_" + col_name(x)), x not in a.maybe and x not in b.maybe)
        if on is not None:
            def column(name):
                if name in shared:
                    return F.coalesce(_c(name), F.col("r_" + col_name(name))) if name in a.maybe else _c(name)
                return _c(name) if name in a.names else F.col("r_" + col_name(name)) if name in b.names else None

            cond = cond & to_bool(Compiler(column, error=SparqlError, kinds=kinds)(on))
        plain = not shared and on is None
        df = a.df.crossJoin(right) if plain and how == "inner" else a.df.join(right, cond, how)
        columns = []
        for x in names:
            if x in shared:
                columns.append((F.coalesce(_c(x), F.col("r_" + col_name(x))) if x in a.maybe else _c(x)).alias(col_name(x)))
            else:
                columns.append(_c(x) if x in a.names else F.col("r_" + col_name(x)).alias(col_name(x)))
        return Solution(df.select(*columns, *([] if columns else [F.lit(1).alias("_unit")])), names, maybe, kinds)

    def split_join(self, a: Solution, b: Solution, shared: list, names: list) -> DataFrame:
        """A join on variables that may be unbound: for every set of those that are bound on both sides, an equi-join."""

        def split(sol: Solution):
            for mask in product(*[(True, False) if x in sol.maybe else (True,) for x in shared]):
                df = sol.df
                for x, bound in zip(shared, mask):
                    if x in sol.maybe:
                        df = df.where(_c(x).isNotNull() if bound else _c(x).isNull())
                yield mask, df

        parts = []
        rights = [(mask, df.select(*[_c(x).alias("r_" + col_name(x)) for x in b.names])) for mask, df in split(b)]
        for mask, left in split(a):
            for other, right in rights:
                keys = [x for x, p, q in zip(shared, mask, other) if p and q]
                both = reduce(lambda c, x: c & (_c(x) == F.col("r_" + col_name(x))), keys[1:], _c(keys[0]) == F.col("r_" + col_name(keys[0]))) if keys else None
                df = left.join(right, both) if keys else left.crossJoin(right)
                columns = [F.coalesce(_c(x), F.col("r_" + col_name(x))) if x in shared else _c(x) if x in a.names else F.col("r_" + col_name(x)) for x in names]
                parts.append(df.select(*[c.alias(col_name(x)) for c, x in zip(columns, names)]))
        return reduce(DataFrame.union, parts)

    def on_join(self, node: Join) -> Solution:
        return self.join(self.compile(node.left), self.compile(node.right))

    def on_leftjoin(self, node: LeftJoin) -> Solution:
        left, right = self.compile(node.left), self.compile(node.right)
        return self.join(left, right, "left", node.on)

    def on_union(self, node: Union) -> Solution:
        parts = [self.compile(x) for x in node.parts]
        names = list(dict.fromkeys(x for p in parts for x in p.names))
        dfs = [p.df.select(*[_c(x) if x in p.names else F.lit(None).cast("string").alias(col_name(x)) for x in names], *([] if names else [F.lit(1).alias("_unit")])) for p in parts]
        maybe = {x for x in names if any(x not in p.names or x in p.maybe for p in parts)}
        kinds = {x: k[0] for x in names if len(k := list({p.kinds.get(x) for p in parts if x in p.names})) == 1 and k[0]}
        return Solution(reduce(DataFrame.union, dfs), names, maybe, kinds)

    def on_minus(self, node: Minus) -> Solution:
        a, b = self.compile(node.left), self.compile(node.right)
        shared = [x for x in a.names if x in b.names]
        if not shared:
            return a
        if not any(x in a.maybe or x in b.maybe for x in shared):
            return Solution(a.df.join(b.df, [col_name(x) for x in shared], "left_anti"), a.names, a.maybe, a.kinds)
        df = a.df  # for every set of variables that may be unbound in b, and in the row, an equi-join on the others
        for other in product(*[(True, False) if x in b.maybe else (True,) for x in shared]):
            right = b.df.select(*[_c(x) for x in shared])
            for x, bound in zip(shared, other):
                right = right.where(_c(x).isNotNull() if bound else _c(x).isNull())
            own = [x for x, bound in zip(shared, other) if bound]
            for mask in product(*[(True, False) if x in a.maybe else (True,) for x in own]):
                keys = [x for x, bound in zip(own, mask) if bound]
                if keys:  # a row in which one of the others is bound isn't this set's: its key is kept apart by a null
                    gone = right.select(*[_c(x).alias("r_" + col_name(x)) for x in keys]).distinct()
                    rest = [x for x in own if x not in keys]
                    cond = reduce(lambda c, x: c & (_c(x) == F.col("r_" + col_name(x))), keys, F.lit(True))
                    df = df.join(gone, reduce(lambda c, x: c & _c(x).isNull(), rest, cond), "left_anti")
        return Solution(df, a.names, a.maybe, a.kinds)

    def on_filter(self, node: Filter) -> Solution:
        sol = self.compile(node.inner)
        for e in self.conjuncts(node.expr):
            negated = isinstance(e, Call) and e.name == "!" and isinstance(e.args[0], Exists)
            if isinstance(e, Exists) or negated:
                x = e.args[0] if negated else e
                sol = self.semi(sol, x.inner, x.negated != negated)
            else:
                sol, value = self.evaluate(sol, e)
                sol = Solution(sol.df.where(to_bool(value)).drop(*[c for c in sol.df.columns if c.startswith("_e")]), sol.names, sol.maybe, sol.kinds)
        return sol

    def conjuncts(self, e) -> list:
        return [y for x in e.args for y in self.conjuncts(x)] if isinstance(e, Call) and e.name == "&&" else [e]

    def semi(self, a: Solution, inner, negated: bool) -> Solution:
        """EXISTS as a semi-join; filters of the inner group that use outer variables join its condition."""
        on = []
        while isinstance(inner, Filter):
            on.extend(self.conjuncts(inner.expr))
            inner = inner.inner
        scope = set(variables(inner))
        own = [e for e in on if not isinstance(e, Exists) and self.free(e) <= scope or isinstance(e, Exists)]
        outer = [e for e in on if e not in own]
        for e in own:
            inner = Filter(e, inner)
        b = self.compile(inner)
        shared = [x for x in a.names if x in b.names]
        how = "left_anti" if negated else "left_semi"
        if not outer and shared and not any(x in a.maybe or x in b.maybe for x in shared):
            return Solution(a.df.join(b.df, [col_name(x) for x in shared], how), a.names, a.maybe, a.kinds)
        right = b.df.select(*[_c(x).alias("r_" + col_name(x)) for x in b.names], F.lit(1).alias("_r"))
        cond = F.lit(True)
        for x in shared:
            cond = cond & compatible(_c(x), F.col("r_" + col_name(x)), x not in a.maybe and x not in b.maybe)
        column = lambda n: F.col("r_" + col_name(n)) if n in b.names else _c(n) if n in a.names else None
        kinds = {**a.kinds, **b.kinds}
        for e in outer:
            cond = cond & to_bool(Compiler(column, error=SparqlError, kinds=kinds)(e))
        return Solution(a.df.join(right, cond, how), a.names, a.maybe, a.kinds)

    def compatible_rows(self, a: Solution, b: Solution, shared: list) -> DataFrame:
        """Rows of a with a compatible one in b: for every set of variables that are unbound in either, an equi-join."""
        parts = []
        for mask in product(*[(True, False) if n in a.maybe else (True,) for n in shared]):
            left = a.df
            for n, bound in zip(shared, mask):
                left = left.where(_c(n).isNotNull() if bound else _c(n).isNull())
            own = [n for n, bound in zip(shared, mask) if bound]
            for other in product(*[(True, False) if n in b.maybe else (True,) for n in own]):
                right = b.df
                for n, bound in zip(own, other):
                    right = right.where(_c(n).isNotNull() if bound else _c(n).isNull())
                keys = [n for n, bound in zip(own, other) if bound]
                if keys:
                    parts.append(left.join(right.select(*[_c(n) for n in keys]).distinct(), [col_name(n) for n in keys], "left_semi").select(a.df.columns))
                else:
                    parts.append(left.join(F.broadcast(right.limit(1).select(F.lit(1).alias("_one"))), how="cross").drop("_one"))
        return reduce(DataFrame.union, parts).distinct()

    def free(self, e) -> set:
        if isinstance(e, Var):
            return {e.name}
        if isinstance(e, Call):
            return set().union(*[self.free(x) for x in e.args]) if e.args else set()
        if isinstance(e, Agg):
            return self.free(e.arg) if e.arg is not None else set()
        return set()

    def evaluate(self, sol: Solution, e, aggregate=None) -> tuple[Solution, Value]:
        """Value of an expression over a solution; EXISTS inside it adds a flag column first."""
        state = {"sol": sol, "n": 0}

        def exists(x: Exists) -> Column:
            state["n"] += 1
            flag, s = f"_e{state['n']}", state["sol"]
            b = self.compile(x.inner)
            shared = [n for n in s.names if n in b.names]
            if any(n in s.maybe or n in b.maybe for n in shared):  # rows are numbered, and those that find a partner are marked
                row = f"_row{state['n']}"
                df = durable.cut(s.df.withColumn(row, F.monotonically_increasing_id()))
                found = self.compatible_rows(Solution(df, s.names, s.maybe), b, shared).select(row).withColumn(flag, F.lit(True))
                df = df.join(found, row, "left").drop(row)
            elif shared:
                hit = b.df.select(*[_c(n) for n in shared]).distinct().withColumn(flag, F.lit(True))
                df = s.df.join(hit, [col_name(n) for n in shared], "left")
            else:
                df = s.df.crossJoin(b.df.limit(1).agg((F.count("*") > 0).alias(flag)))
            state["sol"] = Solution(df, s.names, s.maybe, s.kinds)
            out = F.coalesce(F.col(flag), F.lit(False))
            return ~out if x.negated else out

        column = lambda n: _c(n) if n in sol.names else None
        value = Compiler(column, aggregate, exists, SparqlError, kinds=sol.kinds)(e)
        return state["sol"], value

    def on_extend(self, node: Extend) -> Solution:
        sol = self.compile(node.inner)
        if node.var in sol.names:
            raise SparqlError(f"SPARQL parse error: ?{node.var} is bound already")
        sol, value = self.evaluate(sol, node.expr)
        df = sol.df.withColumn(col_name(node.var), to_term(value).cast("string"))
        return Solution(df.drop(*[c for c in df.columns if c.startswith("_e")]), sol.names + [node.var], sol.maybe | {node.var}, sol.kinds)

    def on_values(self, node: Values) -> Solution:
        schema = ", ".join(f"`{col_name(n)}` string" for n in node.names) or "_unit int"
        rows = [tuple(r) for r in node.rows] if node.names else [(1,) for _ in node.rows]
        return Solution(self.spark.createDataFrame(rows, schema), list(node.names), {n for i, n in enumerate(node.names) if any(r[i] is None for r in node.rows)})

    def on_graph(self, node: Graph) -> Solution:
        outer, self.graph = self.graph, node.name
        try:
            return self.compile(node.inner)
        finally:
            self.graph = outer

    def on_service(self, node: Service) -> Solution:
        if node.silent:
            return self.unit()
        raise SparqlError("SPARQL evaluation error: SERVICE isn't available")

    def on_query(self, q: Query) -> Solution:
        return self.select(q)

    # queries

    def select(self, q: Query) -> Solution:
        sol = self.compile(q.where)
        if q.values is not None:
            sol = self.join(sol, self.on_values(q.values))
        items = q.select if q.select is not None else [(n, None) for n in sol.names if not n.startswith(".")]
        grouped = q.group is not None or any(self.has_aggregate(e) for _, e in items if e is not None) or any(self.has_aggregate(e) for e in q.having)
        order = list(q.order)
        if grouped:
            sol, items, order = self.group(sol, q, items)
        for name, e in items:
            if e is not None:
                sol, value = self.evaluate(sol, e)
                sol = Solution(sol.df.withColumn(col_name(name), to_term(value).cast("string")), sol.names + [name], sol.maybe | {name}, sol.kinds)
        names = [n for n, _ in items]
        df = sol.df
        missing = [n for n in names if n not in sol.names]
        for n in missing:
            df = df.withColumn(col_name(n), F.lit(None).cast("string"))
        keys = []
        for e, up in order:
            sol2, value = self.evaluate(Solution(df, sol.names, sol.maybe, sol.kinds), e)
            df = sol2.df
            for k in order_keys(value):
                keys.append(k.asc_nulls_first() if up else k.desc_nulls_last())
        out = [_c(n) for n in names] or [F.lit(1).alias("_unit")]
        if q.distinct:
            df = df.select(*out).distinct()  # ORDER BY after DISTINCT can only use what is projected
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solution(df.select(*out), names, (sol.maybe & set(names)) | set(missing))

    def has_aggregate(self, e) -> bool:
        return isinstance(e, Agg) or isinstance(e, Call) and any(self.has_aggregate(x) for x in e.args if not isinstance(x, str))

    def group(self, sol: Solution, q: Query, items: list):
        """Aggregate; returns the grouped solution, and items and order rewritten to read from it."""
        keys: list[tuple[str, object]] = []
        for i, (e, name) in enumerate(q.group or []):
            if isinstance(e, Var) and name is None:
                keys.append((e.name, e))
            else:
                name = name or f".k{i}"
                sol, value = self.evaluate(sol, e)
                sol = Solution(sol.df.withColumn(col_name(name), to_term(value).cast("string")), sol.names + [name], sol.maybe | {name}, sol.kinds)
                keys.append((name, e))
        aggs: dict = {}

        def lift(e):
            for name, k in keys:
                if e == k:
                    return Var(name)
            if isinstance(e, Agg):
                if e not in aggs:
                    aggs[e] = f".a{len(aggs)}"
                return Var(aggs[e])
            if isinstance(e, Call):
                return Call(e.name, tuple(x if isinstance(x, str) else lift(x) for x in e.args))
            return e

        new_items = [(n, None if e is None else lift(e)) for n, e in items]
        having = [lift(e) for e in q.having]
        alias = {n: e for n, e in new_items if e is not None}
        order = [(lift(e), up) for e, up in q.order]
        columns = []
        for e, name in aggs.items():
            columns.append(to_term(self.aggregate(sol, e)).cast("string").alias(col_name(name)))
        names = [n for n, _ in keys]
        by = [_c(n) if n in sol.names else F.lit(None).cast("string").alias(col_name(n)) for n in names]
        df = sol.df.groupBy(*by).agg(*columns) if columns else sol.df.select(*by).distinct()
        out = Solution(df, names + list(aggs.values()), set(sol.maybe) | set(aggs.values()), {n: k for n, k in sol.kinds.items() if n in names})
        for e in having:
            out, value = self.evaluate(out, self.inline(e, alias))
            out = Solution(out.df.where(to_bool(value)), out.names, out.maybe, out.kinds)
        items2 = [(n, e) for n, e in new_items]
        return out, items2, order

    def inline(self, e, alias: dict):
        if isinstance(e, Var) and e.name in alias:
            return alias[e.name]
        return Call(e.name, tuple(x if isinstance(x, str) else self.inline(x, alias) for x in e.args)) if isinstance(e, Call) else e

    def aggregate(self, sol: Solution, e: Agg) -> Value:
        if e.arg is None:
            if e.distinct:
                return integer(F.count_distinct(F.struct(*[F.coalesce(_c(n), F.lit("")) for n in sol.names if not n.startswith(".")])))
            return integer(F.count(F.lit(1)))
        value = Compiler(lambda n: _c(n) if n in sol.names else None, error=SparqlError, kinds=sol.kinds)(e.arg)
        t = to_term(value)
        if e.name == "COUNT":
            return integer(F.count_distinct(t) if e.distinct else F.count(t))
        if e.name == "SAMPLE":
            return term(F.min(t))
        if e.name in ("MIN", "MAX"):
            least = F.min if e.name == "MIN" else F.max
            if value.hint in CANONICAL:  # one way to write each value: the least number, written again
                return term(written(least(to_num(value).dec), value.hint), hint=value.hint)
            if value.hint == "dateTime":  # all of one length
                return term(least(t), hint=value.hint)
            if value.hint in ("string", "iri"):
                text = least(bare(t, value.hint))
                return term(F.concat(F.lit("<"), text, F.lit(">")) if value.hint == "iri" else T.as_literal(text), hint=value.hint)
            k = F.when(t.isNotNull(), F.struct(*order_keys(value)))
            return term((F.min_by if e.name == "MIN" else F.max_by)(t, k))
        if e.name == "GROUP_CONCAT":
            text = string_arg(value)
            text = F.coalesce(text, F.when(t.isNotNull(), F.coalesce(F.regexp_extract(t, r'(?s)^"(.*)"', 1), t)))
            parts = F.sort_array(F.collect_set(text)) if e.distinct else F.sort_array(F.collect_list(text))
            return string(F.array_join(parts, e.separator))
        n = to_num(value)
        if e.distinct:
            total_dec, total_dbl, many = F.sum_distinct(n.dec), F.sum_distinct(n.dbl), F.count_distinct(n.dbl)
        else:
            total_dec, total_dbl, many = F.sum(n.dec), F.sum(n.dbl), F.count(n.dbl)
        whole = F.count(t) == F.count(n.dbl)  # one value that isn't a number makes an error
        rank = F.coalesce(F.max(n.rank), F.lit(0))
        if e.name == "SUM":
            return Value("num", rank=F.when(whole, rank), dec=F.coalesce(total_dec.cast(DEC), F.lit(0).cast(DEC)), dbl=F.coalesce(total_dbl, F.lit(0.0)))
        dec = F.coalesce(F.try_divide(total_dec, many).cast(DEC), F.lit(0).cast(DEC))
        return Value("num", rank=F.when(whole, F.when(many == 0, 0).otherwise(F.greatest(rank, F.lit(1)))), dec=dec, dbl=F.coalesce(total_dbl / many, F.lit(0.0)))

    def construct(self, q: Query) -> DataFrame:
        sol = self.compile(q.where) if q.values is None else self.join(self.compile(q.where), self.on_values(q.values))
        sol = self.page(sol, q)
        return self.instantiate(sol, [(*t, None) for t in q.template]).select("s", "p", "o").distinct()

    def page(self, sol: Solution, q: Query) -> Solution:
        df = sol.df
        keys = []
        for e, up in q.order:
            s2, value = self.evaluate(Solution(df, sol.names, sol.maybe, sol.kinds), e)
            df = s2.df
            keys += [k.asc_nulls_first() if up else k.desc_nulls_last() for k in order_keys(value)]
        df = df.orderBy(*keys) if keys else df
        df = df.offset(q.offset) if q.offset else df
        return Solution(df.limit(q.limit) if q.limit is not None else df, sol.names, sol.maybe, sol.kinds)

    def instantiate(self, sol: Solution, template: list) -> DataFrame:
        """(s, p, o, g) of a template over a solution: triples with an unbound or illegal part are left out; labels of
        blank nodes are new for each solution."""
        labels = any(isinstance(x, str) and x.startswith("_:") for t in template for x in t[:3])
        df = sol.df.withColumn("_row", F.uuid()) if labels else sol.df

        def value(x) -> Column:
            if isinstance(x, Var):
                return _c(x.name) if x.name in sol.names else F.lit(None).cast("string")
            if isinstance(x, Quoted):
                return F.concat(F.lit("<< "), value(x.s), F.lit(" "), value(x.p), F.lit(" "), value(x.o), F.lit(" >>"))
            if x is not None and x.startswith("_:"):
                return F.concat(F.lit(x + "r"), F.replace(F.col("_row"), F.lit("-"), F.lit("")))
            return F.lit(x).cast("string")

        rows = F.array(*[F.struct(value(s).alias("s"), value(p).alias("p"), value(o).alias("o"), value(g).alias("g"), F.lit(g is not None).alias("_named")) for s, p, o, g in template])
        out = df.select(F.explode(rows).alias("t")).select("t.*")
        return out.where(F.col("s").isNotNull() & F.col("o").isNotNull() & ~is_literal(F.col("s")) & is_iri(F.col("p")) & (~F.col("_named") | is_iri(F.col("g")))).select("s", "p", "o", "g")

    def describe(self, q: Query) -> DataFrame:
        """All triples whose subject is described, and those of the blank nodes that they lead to."""
        names = [t.name for t in q.describe if isinstance(t, Var)]
        parts = [self.spark.createDataFrame([(t,) for t in q.describe if isinstance(t, str)], "n string")]
        if names or not q.describe:
            sol = self.page(self.compile(q.where), q)
            parts += [sol.df.select(_c(n).alias("n")) for n in (names or [x for x in sol.names if not x.startswith(".")])]
        nodes = reduce(DataFrame.union, parts).where("n IS NOT NULL").distinct()
        quads = self.quads(None)
        found = quads.join(nodes.withColumnRenamed("n", "s"), "s", "left_semi").select("s", "p", "o")
        edges = quads.where(is_blank(F.col("o"))).select("s", "o")
        blank = closure.reachable(found.where(is_blank(F.col("o"))).selectExpr("o AS n"), edges).union(found.where(is_blank(F.col("o"))).selectExpr("o AS n")).distinct()
        more = quads.join(blank.withColumnRenamed("n", "s"), "s", "left_semi").select("s", "p", "o")
        return found.union(more).distinct()


def run(source, q: Query) -> DataFrame:
    """SELECT: a column per variable; ASK: one boolean column `ask`; CONSTRUCT and DESCRIBE: (s, p, o)."""
    c = QueryCompiler(source, q.default, q.named)
    if q.form == "SELECT":
        sol = c.select(q)
        return sol.df.select(*[_c(n).alias(n) for n in sol.names])
    if q.form == "ASK":
        sol = c.page(c.compile(q.where), q)
        return sol.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
    return c.construct(q) if q.form == "CONSTRUCT" else c.describe(q)
