"""GraphStore: a set of quads as tables of one session, with the reference surface of functions as methods.

An insert writes what is new as a further part of the table; a delete writes the table anew and swaps it in whole. Either
way a failed call changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.algebra import Query, Update
from ..plans.compiler import QuadTable, QueryCompiler, run
from ..plans.parser import SparqlError, parse_query, parse_update
from ..sources.rdfxml import parse_rdfxml
from ..sources.turtle import parse_ntriples, parse_turtle
from . import consistency, dred, durable, reasoner, shacl
from .durable import cut

QUADS = "s string, p string, o string, g string"
KEY = ["s", "p", "o", "g"]
MOST_PARTS = 32


def options(cls, raw: str | dict | None):
    given = json.loads(raw) if isinstance(raw, str) and raw else dict(raw or {})
    known = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in given.items() if k in known})


class GraphStore:
    """`path`: a shared folder to keep the store in. Every call that changes it publishes a new manifest of its parts there,
    whole or not at all, and GraphStore(spark, path=...) opens the last one again; a writer that lost a race fails. The
    dependency index of materialisation belongs to the session.
    """

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, path: str | None = None):
        self.spark, self.path, self.version = spark, path.rstrip("/") if path else None, 0
        self.quads, self.folders = spark.createDataFrame([], QUADS), []
        self.graphs: set[str] = set()  # named graphs that CREATE has made
        self.deps: DataFrame | None = None
        self.parts, self.viewed, self._inside = 1, False, False
        if self.path:
            self._open()
        if quads is not None:
            with self._change():
                self._replace(quads.select(*KEY).distinct())

    def _open(self) -> None:
        known = [n for n in durable.names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        if known:
            state = json.loads(durable.read_text(self.spark, f"{self.path}/{known[-1]}"))
            self.version, self.folders, self.graphs = state["version"], state["parts"], set(state["graphs"])
            self.parts = max(1, len(self.folders))
            if self.folders:
                self.quads = self.spark.read.schema(QUADS).parquet(*[f"{self.path}/{f}" for f in self.folders])

    @contextmanager
    def _change(self) -> Iterator[None]:
        """What happens inside takes effect as a whole: a failure leaves the store as it was."""
        if self._inside:
            yield
            return
        saved = self.quads, self.parts, set(self.graphs), self.deps, list(self.folders)
        self._inside = True
        try:
            yield
            if self.path and (self.folders != saved[4] or self.graphs != saved[2]):
                body = json.dumps({"version": self.version + 1, "parts": self.folders, "graphs": sorted(self.graphs)})
                if not durable.publish(self.spark, f"{self.path}/manifest-{self.version + 1:012d}.json", body):
                    raise RuntimeError(f"version {self.version + 1} of {self.path} was written by another writer")
                self.version += 1
        except BaseException:
            self.quads, self.parts, self.graphs, self.deps, self.folders = saved
            raise
        finally:
            self._inside = False
        if self.viewed and self.quads is not saved[0]:
            self.create_views()

    def _written(self, quads: DataFrame) -> DataFrame:
        if not self.path:
            return cut(quads)
        self.folders.append("part-" + uuid.uuid4().hex)
        return cut(quads, f"{self.path}/{self.folders[-1]}")

    # helpers

    @staticmethod
    def graph_name(g: str | None) -> str | None:
        if g is None:
            return None
        if g == "":
            raise T.TermError("Invalid argument: graph name is empty")
        if g.startswith("_:"):
            raise T.TermError("Invalid argument: blank-node graphs are not supported")
        return T.encode_iri(g)

    def rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, QUADS)

    def _replace(self, quads: DataFrame) -> None:
        self.folders = []
        self.quads, self.parts = self._written(quads), 1

    def _append(self, new: DataFrame) -> None:
        """Add a written part; the table is rewritten only when many parts have gathered."""
        self.quads, self.parts = self.quads.union(new), self.parts + 1
        if self.parts > MOST_PARTS:
            self._replace(self.quads)

    def _match(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Join on whole quads; the default graph equals itself."""
        r = right.select(*[F.col(c).alias("_" + c) for c in KEY])
        return left.join(r, (left["s"] == r["_s"]) & (left["p"] == r["_p"]) & (left["o"] == r["_o"]) & left["g"].eqNullSafe(r["_g"]), how)

    def insert_df(self, rows: DataFrame) -> int:
        """Add quads (s, p, o, g) of a DataFrame; returns how many are new."""
        with self._change():
            new = self._written(self._match(rows.select(*KEY).distinct(), self.quads, "left_anti"))
            n = new.count()
            if n:
                self._append(new)
            elif self.path:
                self.folders.pop()
        return n

    def delete_df(self, rows: DataFrame) -> int:
        with self._change():
            n = self._match(self.quads, rows.select(*KEY).distinct(), "left_semi").count()
            if n:
                self._replace(self._match(self.quads, rows, "left_anti"))
        return n

    # single quads and batches

    def quad(self, s: str, p: str, o: str, g: str | None = None) -> tuple:
        return T.parse_term(s, "subject"), T.parse_term(p, "predicate"), T.parse_term(o), self.graph_name(g)

    def rdf_insert(self, s: str, p: str, o: str, g: str | None = None) -> int:
        self.insert_df(self.rows([self.quad(s, p, o, g)]))
        return 1

    def rdf_delete(self, s: str, p: str, o: str, g: str | None = None) -> int:
        self.delete_df(self.rows([self.quad(s, p, o, g)]))
        return 1

    def parse_rows(self, text: str) -> list[tuple]:
        """Rows of a JSON batch, all parsed before any is used."""
        try:
            rows = json.loads(text)
        except ValueError as e:
            raise T.TermError(f"JSON error: {e}") from e
        if not isinstance(rows, list):
            raise T.TermError("Invalid argument: expected a JSON array of rows")
        out = []
        for i, row in enumerate(rows):
            if not isinstance(row, list) or len(row) not in (3, 4):
                raise T.TermError(f"Invalid argument: row {i}: expected 3 or 4 elements")
            for name, x in zip(("subject", "predicate", "object"), row):
                if not isinstance(x, str):
                    raise T.TermError(f"Invalid argument: row {i}: {name} must be a string")
            if len(row) == 4 and not (row[3] is None or isinstance(row[3], str)):
                raise T.TermError(f"Invalid argument: row {i}: graph must be a string or null")
            try:
                out.append(self.quad(*row))
            except T.TermError as e:
                raise T.TermError(f"Invalid argument: row {i}: {e}") from e
        return out

    def rdf_insert_many(self, text: str) -> int:
        return self.insert_df(self.rows(self.parse_rows(text)))

    def rdf_delete_many(self, text: str) -> int:
        return self.delete_df(self.rows(self.parse_rows(text)))

    def rdf_clear(self) -> int:
        with self._change():
            self.quads, self.parts, self.graphs, self.deps, self.folders = self.spark.createDataFrame([], QUADS), 1, set(), None, []
        return 1

    def rdf_count(self, *graph: str | None) -> int:
        if not graph or graph[0] is None:
            return self.quads.where("g IS NULL").count()
        try:
            return self.quads.where(F.col("g") == T.encode_iri(graph[0])).count()
        except T.TermError:
            return 0

    def rdf_count_all(self) -> int:
        return self.quads.count()

    # documents

    def _load(self, rows: list[tuple], g: str | None) -> int:
        graph = self.graph_name(g)
        if rows:
            self.insert_df(self.rows([(*r, graph) for r in rows]))
        return len(rows)

    def rdf_load_turtle(self, text: str) -> int:
        return self._load(parse_turtle(text, self._scope()), None)

    def rdf_load_turtle_to_graph(self, text: str, g: str | None) -> int:
        return self._load(parse_turtle(text, self._scope()), g)

    def rdf_load_ntriples(self, text: str) -> int:
        return self._load(parse_ntriples(text, self._scope()), None)

    def rdf_load_ntriples_to_graph(self, text: str, g: str | None) -> int:
        return self._load(parse_ntriples(text, self._scope()), g)

    def rdf_load_rdfxml(self, text: str) -> int:
        return self._load(parse_rdfxml(text, self._scope()), None)

    def rdf_load_rdfxml_to_graph(self, text: str, g: str | None) -> int:
        return self._load(parse_rdfxml(text, self._scope()), g)

    @staticmethod
    def _scope() -> str:
        return "d" + uuid.uuid4().hex[:12]

    def dump_df(self) -> DataFrame:
        """(value): a line of N-Triples per quad, graph names dropped."""
        return self.quads.select(F.concat_ws(" ", *[T.to_ntriples(F.col(c)) for c in "spo"], F.lit(".")).alias("value"))

    def rdf_dump_ntriples(self) -> str:
        return "".join(r["value"] + "\n" for r in self.dump_df().toLocalIterator())

    # terms

    def _scalar(self, text: str, f) -> str:
        return self.spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]

    def rdf_term_type(self, text: str) -> str:
        return self._scalar(text, T.term_type)

    def rdf_term_value(self, text: str) -> str:
        return self._scalar(text, T.term_value)

    @staticmethod
    def _part(text: str, i: int) -> str:
        return T.split_quoted(T.parse_quoted(text))[i]

    def rdf_triple_subject(self, text: str) -> str:
        return self._part(text, 0)

    def rdf_triple_predicate(self, text: str) -> str:
        return self._part(text, 1)

    def rdf_triple_object(self, text: str) -> str:
        return self._part(text, 2)

    # queries

    def source(self) -> QuadTable:
        return QuadTable(self.quads)

    def sparql(self, text: str) -> DataFrame:
        """Any query form as a DataFrame."""
        return run(self.source(), parse_query(text))

    def _form(self, text: str, forms: tuple, name: str) -> Query:
        q = parse_query(text)
        if q.form not in forms:
            raise SparqlError(f"SPARQL evaluation error: {name} expects {' or '.join(forms)}")
        return q

    def sparql_query(self, text: str) -> str:
        df = run(self.source(), self._form(text, ("SELECT",), "sparql_query"))
        return json.dumps([{k: v for k, v in sorted(r.asDict().items()) if v is not None} for r in df.collect()], ensure_ascii=False)

    def sparql_ask(self, text: str) -> int:
        return int(run(self.source(), self._form(text, ("ASK",), "sparql_ask")).first()["ask"])

    def sparql_construct(self, text: str) -> str:
        return self._lines(run(self.source(), self._form(text, ("CONSTRUCT", "DESCRIBE"), "sparql_construct")))

    @staticmethod
    def _line() -> Column:
        return F.concat_ws(" ", "s", "p", "o", F.lit(".\n")).alias("line")

    def _lines(self, df: DataFrame) -> str:
        return "".join(df.select(self._line()).toArrow()["line"].to_pylist())

    def rdf_construct_many(self, text: str) -> str:
        queries = json.loads(text)
        if not isinstance(queries, list) or not all(isinstance(q, str) for q in queries):
            raise SparqlError("Invalid argument: expected a JSON array of strings")
        parsed = []
        for i, q in enumerate(queries):
            try:
                parsed.append(parse_query(q))
            except ValueError as e:
                raise SparqlError(f"SPARQL parse error (query index {i}): {e}") from e
        parts = []
        for i, q in enumerate(parsed):
            if q.form not in ("CONSTRUCT", "DESCRIBE"):
                raise SparqlError(f"SPARQL evaluation error (query index {i}): expected CONSTRUCT")
            parts.append(run(self.source(), q).select(F.lit(i).alias("i"), self._line()))
        out: list[list[str]] = [[] for _ in parsed]  # joined once: adding to a text copies all of it
        if parts:
            every = parts[0]
            for p in parts[1:]:
                every = every.union(p)
            for b in every.toArrow().to_batches():
                for i, line in zip(b.column("i").to_pylist(), b.column("line").to_pylist()):
                    out[i].append(line)
        return json.dumps(["".join(x) for x in out], ensure_ascii=False)

    # updates

    def sparql_update(self, text: str) -> int:
        """Runs all operations, or none if one fails; returns the change of the number of quads."""
        updates = parse_update(text)
        before = self.rdf_count_all()
        with self._change():
            for u in updates:
                self._update(u)
        return self.rdf_count_all() - before

    def _update(self, u: Update) -> None:
        if u.kind in ("insert_data", "delete_data"):
            rows = [(s, p, o, g) for s, p, o, g in (u.insert if u.kind == "insert_data" else u.delete)]
            if any(not isinstance(x, str) for r in rows for x in r[:3]):
                raise SparqlError("SPARQL parse error: DATA holds a variable")
            scope = self._scope()
            rows = [tuple(x + scope if isinstance(x, str) and x.startswith("_:") else x for x in r) for r in rows]
            (self.insert_df if u.kind == "insert_data" else self.delete_df)(self.rows(rows))
        elif u.kind == "modify":
            c = QueryCompiler(self.source(), u.using, u.using_named)
            sol = c.compile(u.where)
            sol.df = cut(sol.df)  # evaluated once for both templates
            gone = c.instantiate(sol, u.delete).distinct() if u.delete else self.rows([])
            new = c.instantiate(sol, u.insert).distinct() if u.insert else self.rows([])
            kept = self._match(self.quads, gone, "left_anti") if u.delete else self.quads
            self._replace(kept.union(new).distinct())
        elif u.kind == "load":
            if not u.silent:
                raise SparqlError("SPARQL evaluation error: LOAD isn't available")
        elif u.kind == "create":
            if not u.silent and (u.target in self.graphs or not self.quads.where(F.col("g") == u.target).isEmpty()):
                raise SparqlError(f"SPARQL evaluation error: graph {u.target} exists already")
            self.graphs.add(u.target)
        elif u.kind in ("clear", "drop"):
            self._need(u.target, u.silent)
            test = {"DEFAULT": F.col("g").isNull(), "NAMED": F.col("g").isNotNull(), "ALL": F.lit(True)}.get(u.target, F.col("g").eqNullSafe(F.lit(u.target)))
            self._replace(self.quads.where(~test))
            if u.kind == "drop":
                self.graphs = {g for g in self.graphs if u.target not in ("NAMED", "ALL") and g != u.target}
        else:  # copy, move, add
            self._need(u.source, u.silent)
            if u.source == u.target:
                return
            name = lambda g: None if g == "DEFAULT" else g
            moved = self.quads.where(F.col("g").eqNullSafe(F.lit(name(u.source)))).withColumn("g", F.lit(name(u.target)).cast("string"))
            rest = self.quads if u.kind == "add" else self.quads.where(~F.col("g").eqNullSafe(F.lit(name(u.target))))
            if u.kind == "move":
                rest = rest.where(~F.col("g").eqNullSafe(F.lit(name(u.source))))
            self._replace(rest.union(moved).distinct())

    def _need(self, g: str, silent: bool) -> None:
        if not silent and g.startswith("<") and g not in self.graphs and self.quads.where(F.col("g") == g).isEmpty():
            raise SparqlError(f"SPARQL evaluation error: graph {g} doesn't exist")

    # reasoning

    def _graph(self, g: str | None) -> DataFrame:
        return self.quads.where(F.col("g").eqNullSafe(F.lit(self.graph_name(g))))

    def rdf_owl_rl_materialise(self, asserted: str | None, inferred: str | None, raw: str | dict | None = None) -> int:
        if not inferred:
            raise T.TermError("Invalid argument: rdf_owl_rl_materialise: inferred graph is required")
        o = options(reasoner.Options, raw)
        name = self.graph_name(inferred)
        result = reasoner.materialise(self._graph(asserted), self._graph(inferred), o, self.graph_name(asserted) == name)
        gained = result.new.withColumn("g", F.lit(name))
        n = self.insert_df(gained)
        if result.derivations is not None:
            d = result.derivations.withColumn("g", F.lit(name))
            for i in "12":
                d = d.withColumn("g" + i, F.when(F.col("g" + i) == "\0inferred", name).otherwise(F.col("g" + i)))
            rows = dred.index(d)
            self.deps = cut(rows if self.deps is None else self.deps.union(rows).distinct())
        if result.error:
            raise reasoner.ReasonerError(f"rdf_owl_rl_materialise: {result.error}")
        return n

    def rdf_owl_rl_consistent(self, asserted: str | None, inferred: str | None, raw: str | dict | None = None) -> str:
        limit = (json.loads(raw) if isinstance(raw, str) and raw else raw or {}).get("max_violations", 10_000)
        u = self._graph(asserted).union(self._graph(inferred)).select("s", "p", "o").distinct() if inferred else self._graph(asserted).select("s", "p", "o").distinct()
        found = consistency.violations(cut(u), limit)
        return json.dumps([r.asDict() for r in found.collect()], ensure_ascii=False)

    def consistent(self, asserted: str | None = None, inferred: str | None = None) -> bool:
        return self.rdf_owl_rl_consistent(asserted, inferred) == "[]"

    def rdf_dred_overdelete(self, inferred: str, text: str) -> int:
        if not inferred:
            raise T.TermError("Invalid argument: rdf_dred_overdelete: inferred graph is required")
        rows = self.parse_rows(text)
        if not rows:
            return 0
        if self.deps is None or self.deps.isEmpty():
            raise T.TermError("Invalid argument: rdf_dred_overdelete: no dependency index; materialise with track_dependencies first")
        with self._change():
            gone = cut(dred.cascade(self.deps, self.rows(rows).select(dred.key().alias("key"))))
            n = gone.count()
            if n:
                self._replace(self.quads.withColumn("key", dred.key()).join(gone, "key", "left_anti").select(*KEY))
                self.deps = cut(dred.forget(self.deps, gone))
        return n

    # validation

    def rdf_shacl_core_validate(self, data: str | None, shapes: str | None, report: str | None, raw: str | dict | None = None) -> int:
        o = options(shacl.Options, raw)
        if self.graph_name(report) in (self.graph_name(data), self.graph_name(shapes)):
            raise T.TermError("Invalid argument: rdf_shacl_core_validate: the report graph must differ from data and shapes")
        rows = [(r["s"], r["p"], r["o"]) for r in self._graph(shapes).collect()]  # a shapes graph is small
        found = shacl.violations(self._graph(data), rows, o.max_violations)
        if o.max_violations is None:  # else written already
            found = cut(found)
        n = found.count()
        target = self.graph_name(report)
        scope = self._scope()
        fresh = shacl.report(found, o)
        own = lambda c: F.when(F.col(c).rlike("^_:(report$|r[0-9a-f]{32}$)"), F.concat(F.col(c), F.lit(scope))).otherwise(F.col(c))
        fresh = fresh.select(own("s").alias("s"), "p", own("o").alias("o"), F.lit(target).cast("string").alias("g"))
        with self._change():
            self._replace(self.quads.where(~F.col("g").eqNullSafe(F.lit(target))).union(fresh))
        return n

    # the virtual table

    def create_views(self) -> None:
        """Temporary views rdf_triples (subject, predicate, object) and rdf_triples_g, with the graph; they follow changes."""
        self.viewed = True
        named = self.quads.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.regexp_replace("g", "^<|>$", "").alias("graph"))
        named.createOrReplaceTempView("rdf_triples_g")
        named.select("subject", "predicate", "object").createOrReplaceTempView("rdf_triples")

    def table_insert(self, rows: DataFrame) -> int:
        """Insert (subject, predicate, object[, graph]) rows; terms are bare or encoded, as in rdf_insert."""
        fix = lambda c, lit: F.when(F.col(c).rlike(r'^(<|_:|")' if lit else "^(<|_:)"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
        g = fix("graph", False) if "graph" in rows.columns else F.lit(None).cast("string")
        g = F.when(F.col("graph").isNotNull(), g) if "graph" in rows.columns else g
        return self.insert_df(rows.select(fix("subject", False).alias("s"), fix("predicate", False).alias("p"), fix("object", True).alias("o"), g.alias("g")))

    def table_delete(self, *_) -> None:
        raise T.TermError("rdf_triples: DELETE and UPDATE are not supported; use rdf_delete")

    table_update = table_delete


def register(spark: SparkSession) -> None:
    """The pure term functions for SQL over any column of encoded terms: rdf_term_type, rdf_term_value, rdf_triple_subject,
    rdf_triple_predicate and rdf_triple_object. Their bodies are SQL expressions, which Catalyst inlines."""
    value = r"""CASE WHEN startswith(t, '<<') THEN CAST(raise_error('rdf_term_value: triple terms have no scalar value') AS STRING) WHEN startswith(t, '<') THEN regexp_replace(substr(t, 2), r'>+$', '')
        WHEN startswith(t, '_:') THEN substr(t, 3) WHEN startswith(t, '"') THEN regexp_extract(t, r'(?s)^"(.*)"', 1) WHEN t IS NOT NULL THEN CAST(raise_error('rdf_term_value: not a term') AS STRING) END"""
    kind = """CASE WHEN startswith(t, '<<') THEN 'triple' WHEN startswith(t, '<') THEN 'iri' WHEN startswith(t, '_:') THEN 'blank' WHEN startswith(t, '"') THEN 'literal' ELSE 'unknown' END"""
    bodies = {"rdf_term_type": kind, "rdf_term_value": value}
    for i, part in enumerate(("subject", "predicate", "object"), 1):
        bodies[f"rdf_triple_{part}"] = f"CASE WHEN startswith(t, '<<') THEN regexp_extract(t, r'{T.QUOTED}', {i}) END"
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {body}")
