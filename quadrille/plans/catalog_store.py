"""Registered queries of the store's functions, of forms and functions of SPARQL, and of rules over graphs of a table's size."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import OWL, RDF, RDFS, SH, TYPE
from ..operators import consistency, lists, reasoner, shacl
from ..operators.durable import shared_folder
from ..operators.store import GraphStore, register
from ..sources.triplify import quads
from ..sources.turtle import parse_turtle
from ..streaming.ingest import ingest
from .catalog import _CUST, _N, ORACLES, PREFIX, QUERIES, TURTLE, _register, _stored, graph, named, shape, sparql, typed, update  # noqa: F401
from .compiler import QuadTable, run
from .parser import parse_query

_QUADS = "s string, p string, o string, g string"


def rows(spark, found: list[tuple]) -> DataFrame:
    """(step, n) of what calls returned."""
    return spark.createDataFrame([(s, int(n)) for s, n in found], "step string, n bigint")


def nations(spark, sf_dir) -> list[tuple[int, str]]:
    return [(r["n_nationkey"], r["n_name"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]


# --- calls of the store ----------------------------------------------------------------------------------------------


@_register("store_single_quads", "SELECT 'insert' AS step, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'again', 1 UNION ALL SELECT 'named', 1 UNION ALL SELECT 'default', 1 + count(*) FROM customer UNION ALL SELECT 'graph', 1 UNION ALL SELECT 'all', 2 + count(*) FROM customer UNION ALL SELECT 'delete', 1 UNION ALL SELECT 'absent', 1 UNION ALL SELECT 'left', count(*) FROM customer UNION ALL SELECT 'none', 0 UNION ALL SELECT 'clear', 1 UNION ALL SELECT 'empty', 0")
def store_single_quads(spark, sf_dir):
    g = GraphStore(spark, quads(spark, sf_dir, ["customer"], ["<urn:r:inNation>"]))
    t = ("urn:d:x", "urn:p:y", '"z"')
    found = [("insert", g.rdf_insert(*t)), ("again", g.rdf_insert(*t)), ("named", g.rdf_insert(*t, "urn:g:n")), ("default", g.rdf_count()), ("graph", g.rdf_count("urn:g:n")), ("all", g.rdf_count_all())]
    found += [("delete", g.rdf_delete(*t)), ("absent", g.rdf_delete(*t, "urn:g:none"))]
    g.rdf_delete(*t, "urn:g:n")
    found += [("left", g.rdf_count_all()), ("none", g.rdf_count("urn:g:n")), ("clear", g.rdf_clear()), ("empty", g.rdf_count_all())]
    return rows(spark, found)


@_register("store_json_batches", "SELECT 'insert' AS step, count(*) AS n FROM nation UNION ALL SELECT 'again', 0 UNION ALL SELECT 'delete', count(*) FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'left', count(*) FROM nation WHERE n_nationkey >= 5")
def store_json_batches(spark, sf_dir):
    g = GraphStore(spark)
    batch = [[f"urn:d:nation:{k}", "urn:p:n_name", f'"{n}"', "urn:g:n"] for k, n in nations(spark, sf_dir)]
    found = [("insert", g.rdf_insert_many(json.dumps(batch + batch))), ("again", g.rdf_insert_many(json.dumps(batch)))]
    found += [("delete", g.rdf_delete_many(json.dumps([r for r in batch if int(r[0].rsplit(":", 1)[1]) < 5]))), ("left", g.rdf_count("urn:g:n"))]
    return rows(spark, found)


@_register("store_loaders", "SELECT step, n FROM (SELECT count(*) AS k FROM nation), (VALUES ('turtle', 2, 0), ('turtle graph', 2, 0), ('ntriples', 1, 0), ('ntriples graph', 1, 0), ('rdfxml', 2, 0), ('rdfxml graph', 2, 0), ('default', 2, 0), ('graph', 2, 0)) v(step, f, z), LATERAL (SELECT CAST(f * k AS BIGINT) AS n)")
def store_loaders(spark, sf_dir):
    """The same triples by every loader; what is loaded twice is there once."""
    own = nations(spark, sf_dir)
    turtle = TURTLE + "".join(f'<urn:d:nation:{k}> a c:Nation ; p:n_name "{n}" .\n' for k, n in own)
    lines = "".join(f'<urn:d:nation:{k}> <urn:p:n_name> "{n}" .\n' for k, n in own)
    xml = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:c="urn:c:" xmlns:p="urn:p:">' + "".join(f'<c:Nation rdf:about="urn:d:nation:{k}"><p:n_name>{n}</p:n_name></c:Nation>' for k, n in own) + "</rdf:RDF>"
    g = GraphStore(spark)
    found = [("turtle", g.rdf_load_turtle(turtle)), ("turtle graph", g.rdf_load_turtle_to_graph(turtle, "urn:g:n")), ("ntriples", g.rdf_load_ntriples(lines)), ("ntriples graph", g.rdf_load_ntriples_to_graph(lines, "urn:g:n"))]
    found += [("rdfxml", g.rdf_load_rdfxml(xml)), ("rdfxml graph", g.rdf_load_rdfxml_to_graph(xml, "urn:g:n")), ("default", g.rdf_count()), ("graph", g.rdf_count("urn:g:n"))]
    return rows(spark, found)


@_register("ntriples_is_strict", "SELECT * FROM (VALUES ('<http://e/a> <http://e/p> \"x\"@en .', true), ('# only a comment', true), ('@prefix : <http://e/> .', false), ('<http://e/a> <http://e/p> 1 .', false), ('<http://e/a> <http://e/p> <http://e/b>, <http://e/c> .', false), ('<a> <http://e/p> <http://e/b> .', false)) v(line, taken)")
def ntriples_is_strict(spark, sf_dir):
    def taken(line: str) -> bool:
        try:
            GraphStore(spark).rdf_load_ntriples(line)
            return True
        except ValueError:
            return False

    lines = ['<http://e/a> <http://e/p> "x"@en .', "# only a comment", "@prefix : <http://e/> .", "<http://e/a> <http://e/p> 1 .", "<http://e/a> <http://e/p> <http://e/b>, <http://e/c> .", "<a> <http://e/p> <http://e/b> ."]
    return spark.createDataFrame([(x, taken(x)) for x in lines], "line string, taken boolean")


@_register("triple_parts", "SELECT '<urn:d:nation:' || n_nationkey || '>' AS s, '<urn:p:n_name>' AS p, '\"' || n_name || '\"' AS o, 'triple' AS kind FROM nation UNION ALL SELECT '<< <urn:d:nation:' || n_nationkey || '> <urn:p:n_name> \"' || n_name || '\" >>', '<urn:p:by>', '_:b', 'triple' FROM nation")
def triple_parts(spark, sf_dir):
    """Parts of quoted triples, also nested ones, by the SQL functions."""
    register(spark)
    t = quads(spark, sf_dir, ["nation"], ["<urn:p:n_name>"]).select(F.concat(F.lit("<< "), "s", F.lit(" "), "p", F.lit(" "), "o", F.lit(" >>")).alias("t"))
    t = t.union(t.select(F.concat(F.lit("<< "), "t", F.lit(" <urn:p:by> _:b >>"))))
    return t.selectExpr("rdf_triple_subject(t) AS s", "rdf_triple_predicate(t) AS p", "rdf_triple_object(t) AS o", "rdf_term_type(t) AS kind")


@_register("sql_term_functions", "SELECT 'iri' AS kind, 'urn:d:nation:' || n_nationkey AS value FROM nation UNION ALL SELECT 'literal', n_name FROM nation")
def sql_term_functions(spark, sf_dir):
    register(spark)
    t = quads(spark, sf_dir, ["nation"], ["<urn:p:n_name>"]).select(F.explode(F.array("s", "o")).alias("t"))
    return t.selectExpr("rdf_term_type(t) AS kind", "rdf_term_value(t) AS value")


@_register("store_query_forms", "SELECT 'ask' AS step, CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_name = 'FRANCE' UNION ALL SELECT 'ask not', 0 UNION ALL SELECT 'select', count(*) FROM nation UNION ALL SELECT 'construct', count(*) FROM nation UNION ALL SELECT 'many 0', count(*) FROM nation UNION ALL SELECT 'many 1', count(*) FROM customer")
def store_query_forms(spark, sf_dir):
    g = _stored(spark, sf_dir)
    many = json.loads(g.rdf_construct_many(json.dumps([PREFIX + "CONSTRUCT { ?n p:label ?x } WHERE { ?n p:n_name ?x }", "CONSTRUCT WHERE { ?c <urn:r:inNation> ?n }"])))
    found = [("ask", g.sparql_ask("ASK { ?x <urn:p:n_name> 'FRANCE' }")), ("ask not", g.sparql_ask("ASK { ?x <urn:p:n_name> 'ATLANTIS' }"))]
    found += [("select", len(json.loads(g.sparql_query("SELECT ?x { ?x <urn:p:n_name> ?n }")))), ("construct", g.sparql_construct("CONSTRUCT WHERE { ?x <urn:p:n_name> ?n }").count(" .\n"))]
    return rows(spark, found + [(f"many {i}", x.count(" .\n")) for i, x in enumerate(many)])


@_register("store_refusals", "SELECT * FROM (VALUES ('load', 'SPARQL evaluation error: LOAD isn''t available'), ('service', 'SPARQL evaluation error: SERVICE isn''t available'), ('create', 'SPARQL evaluation error: graph <urn:g:a> exists already'), ('drop', 'SPARQL evaluation error: graph <urn:g:none> doesn''t exist'), ('table delete', 'rdf_triples: DELETE and UPDATE are not supported; use rdf_delete'), ('left', '0')) v(step, said)")
def store_refusals(spark, sf_dir):
    """What is refused, and that a sequence of updates takes effect as a whole or not at all."""
    g = GraphStore(spark)
    g.sparql_update("CREATE GRAPH <urn:g:a>")

    def said(f, *a) -> str:
        try:
            f(*a)
            return ""
        except ValueError as e:
            return str(e)

    found = [("load", said(g.sparql_update, "INSERT DATA { <urn:a> <urn:b> 1 } ; LOAD <http://e/x>")), ("service", said(g.sparql_query, "SELECT * { SERVICE <http://e/x> { ?s ?p ?o } }")), ("create", said(g.sparql_update, "CREATE GRAPH <urn:g:a>"))]
    found += [("drop", said(g.sparql_update, "INSERT DATA { <urn:a> <urn:b> 1 } ; DROP GRAPH <urn:g:none>")), ("table delete", said(g.table_delete)), ("left", str(g.rdf_count_all()))]
    return spark.createDataFrame(found, "step string, said string")


@_register("store_table", "SELECT 'inserted' AS step, count(*) AS n FROM nation UNION ALL SELECT 'view', count(*) FROM nation UNION ALL SELECT 'view with graphs', count(*) FROM nation UNION ALL SELECT 'view after a change', count(*) + 1 FROM nation")
def store_table(spark, sf_dir):
    """Rows inserted into the table of triples, and its views, which follow the store."""
    g = GraphStore(spark)
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('urn:d:nation:', n_nationkey) AS subject", "'urn:p:n_name' AS predicate", "concat('\"', n_name, '\"') AS object", "'urn:g:n' AS graph")
    found = [("inserted", g.table_insert(own))]
    g.create_views()
    found += [("view", spark.table("rdf_triples").count()), ("view with graphs", spark.sql("SELECT * FROM rdf_triples_g WHERE graph = 'urn:g:n'").count())]
    g.rdf_insert("urn:d:x", "urn:p:y", "urn:d:z")
    return rows(spark, [*found, ("view after a change", spark.table("rdf_triples").count())])


@_register("store_reopened", "SELECT 'first' AS step, count(*) AS n FROM customer UNION ALL SELECT 'reopened', count(*) FROM customer UNION ALL SELECT 'streamed', count(*) FROM supplier UNION ALL SELECT 'at last', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'versions', 2")
def store_reopened(spark, sf_dir):
    """A store in a folder, opened again, fed by a stream of quads, and opened once more."""
    at = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    GraphStore(spark, quads(spark, sf_dir, ["customer"], ["<urn:r:inNation>"]), path=f"{at}/store")
    again = GraphStore(spark, path=f"{at}/store")
    found = [("first", again.rdf_count_all()), ("reopened", GraphStore(spark, path=f"{at}/store").rdf_count_all())]
    quads(spark, sf_dir, ["supplier"], ["<urn:r:inNation>"]).write.parquet(f"{at}/arrivals")
    ingest(spark.readStream.schema(_QUADS).parquet(f"{at}/arrivals"), again, f"{at}/checkpoint").awaitTermination()
    last = GraphStore(spark, path=f"{at}/store")
    added = last.quads.where("startswith(s, '<urn:d:supplier:')").count()
    return rows(spark, [*found, ("streamed", added), ("at last", last.rdf_count_all()), ("versions", last.version)])


# --- updates ---------------------------------------------------------------------------------------------------------

_BASE = "SELECT '<urn:r:inNation>' AS p, count(*) AS n FROM customer UNION ALL SELECT '<urn:p:n_name>', count(*) FROM nation"
_SEGMENT = " UNION ALL SELECT '<urn:p:c_mktsegment>', count(*) FROM customer"
update("delete_data", "INSERT DATA { <urn:d:x> p:y 'z' } ; DELETE DATA { <urn:d:x> p:y 'z' , 'none' }", f"SELECT p, n, CAST(0 AS BIGINT) AS delta FROM ({_BASE}{_SEGMENT})")
update("add_graph", "ADD DEFAULT TO <urn:g:y>", f"SELECT p, 2 * n AS n, (SELECT 2 * count(*) FROM customer) + (SELECT count(*) FROM nation) AS delta FROM ({_BASE}{_SEGMENT})")
update("move_graph", "CREATE GRAPH <urn:g:y> ; MOVE DEFAULT TO <urn:g:y>", f"SELECT p, n, CAST(0 AS BIGINT) AS delta FROM ({_BASE}{_SEGMENT})")
update("drop_graphs", "COPY DEFAULT TO <urn:g:y> ; DROP SILENT GRAPH <urn:g:none> ; DROP NAMED", f"SELECT p, n, CAST(0 AS BIGINT) AS delta FROM ({_BASE}{_SEGMENT})")
update("clear_named", "COPY DEFAULT TO <urn:g:y> ; CLEAR GRAPH <urn:g:y>", f"SELECT p, n, CAST(0 AS BIGINT) AS delta FROM ({_BASE}{_SEGMENT})")
update("with_using", "COPY DEFAULT TO <urn:g:y> ; WITH <urn:g:y> DELETE { ?c p:c_mktsegment ?m } INSERT { ?c p:seen ?m } WHERE { ?c p:c_mktsegment ?m FILTER(?m = 'BUILDING') } ; INSERT { ?n p:copied ?x } USING <urn:g:y> WHERE { ?n p:n_name ?x } ; CLEAR DEFAULT",
       f"SELECT p, n, -(SELECT count(*) FROM nation) * 0 AS delta FROM ({_BASE} UNION ALL SELECT '<urn:p:c_mktsegment>', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT '<urn:p:seen>', count(*) FROM customer WHERE c_mktsegment = 'BUILDING')")
update("load_silent", "LOAD SILENT <http://e/none>", f"SELECT p, n, CAST(0 AS BIGINT) AS delta FROM ({_BASE}{_SEGMENT})")

# --- forms and functions ---------------------------------------------------------------------------------------------

named("from_named", "SELECT ?g (COUNT(*) AS ?n) FROM NAMED <urn:g:BUILDING> FROM NAMED <urn:g:MACHINERY> { GRAPH ?g { ?c r:inNation ?x } } GROUP BY ?g", "g:iri n:long", "SELECT 'urn:g:' || c_mktsegment AS g, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
sparql("reduced", "nation", "SELECT REDUCED ?n { ?x p:n_name ?n }", "n:str", "SELECT n_name AS n FROM nation")
sparql("service_silent", "nation", "SELECT ?n { ?x p:n_name ?n SERVICE SILENT <http://e/x> { ?a ?b ?c } }", "n:str", "SELECT n_name AS n FROM nation")
sparql("exists_unbound", "customer", "SELECT ?c { ?c a c:Customer OPTIONAL { ?c p:c_mktsegment ?m FILTER(?m = 'BUILDING') } FILTER(?c = <urn:d:customer:1> || EXISTS { ?d p:c_mktsegment ?m . FILTER(?d = <urn:d:customer:2>) }) }", "c:iri",
       "SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE c_custkey = 1 OR c_mktsegment <> 'BUILDING' OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = 2 AND c_mktsegment = 'BUILDING')")
sparql("bound_same_term", "customer", "SELECT ?c (BOUND(?m) AS ?b) (sameTerm(?c, <urn:d:customer:1>) AS ?s) { ?c a c:Customer OPTIONAL { ?c p:c_mktsegment ?m FILTER(?m = 'BUILDING') } }", "c:iri b:bool s:bool", "SELECT 'urn:d:customer:' || c_custkey AS c, c_mktsegment = 'BUILDING' AS b, c_custkey = 1 AS s FROM customer")
sparql("string_tests", "customer", "SELECT ?c (STRENDS(?m, 'Y') AS ?e) (ENCODE_FOR_URI(CONCAT(?m, ' é/')) AS ?u) (langMatches('de-AT', 'de') AS ?l) (langMatches('', '*') AS ?k) { ?c p:c_mktsegment ?m }", "c:iri e:bool u:str l:bool k:bool",
       "SELECT 'urn:d:customer:' || c_custkey AS c, c_mktsegment LIKE '%Y' AS e, c_mktsegment || '%20%C3%A9%2F' AS u, true AS l, false AS k FROM customer")
sparql("term_building", "nation", "SELECT ?n (LANG(STRLANG(?n, 'en')) AS ?l) (STR(IRI(CONCAT('urn:x:', STR(?n)))) AS ?i) (STR(DATATYPE(STRDT(?n, <urn:t:name>))) AS ?d) (isBlank(BNODE()) AS ?b) (isIRI(UUID()) AS ?u) (STRLEN(STRUUID()) AS ?k) (RAND() < 1 AS ?r) { ?x p:n_name ?n }", "n:str l:str i:str d:str b:bool u:bool k:long r:bool",
       "SELECT n_name AS n, 'en' AS l, 'urn:x:' || n_name AS i, 'urn:t:name' AS d, true AS b, true AS u, CAST(36 AS BIGINT) AS k, true AS r FROM nation")
sparql("time_parts", "orders", "SELECT ?o (MINUTES(?d) AS ?m) (SECONDS(?d) AS ?s) (TZ(?z) AS ?t) (STR(TIMEZONE(?z)) AS ?q) (YEAR(NOW()) > 2000 AS ?n) { ?o p:o_orderdate ?d BIND('2020-01-01T00:00:00+01:00'^^xsd:dateTime AS ?z) }", "o:iri m:long s:dec t:str q:str n:bool",
       "SELECT 'urn:d:order:' || o_orderkey AS o, minute(o_orderdate) AS m, CAST(second(o_orderdate) AS DECIMAL(18,2)) AS s, '+01:00' AS t, 'PT1H' AS q, true AS n FROM orders")
sparql("long_hashes", "region", "SELECT ?n (SHA384(?n) AS ?a) (SHA512(?n) AS ?b) { ?x p:r_name ?n FILTER(?n = 'ASIA') }", "n:str a:str b:str", "SELECT r_name AS n, '{}' AS a, '{}' AS b FROM region WHERE r_name = 'ASIA'".format(*[hashlib.new(h, b"ASIA").hexdigest() for h in ("sha384", "sha512")]))
sparql("more_casts", "part", "SELECT ?p (xsd:boolean(STR(?s > 25)) AS ?b) (xsd:double(?s) = ?s AS ?d) (xsd:float('1.5') = 1.5 AS ?f) (STR(xsd:dateTime('2020-01-02T03:04:05')) AS ?t) (xsd:decimal('2.50') AS ?e) { ?p p:p_size ?s }", "p:iri b:bool d:bool f:bool t:str e:dec",
       "SELECT 'urn:d:part:' || p_partkey AS p, p_size > 25 AS b, true AS d, true AS f, '2020-01-02T03:04:05' AS t, CAST(2.5 AS DECIMAL(18,2)) AS e FROM part")


def _claims(spark, sf_dir) -> QuadTable:
    """Quoted triples over the customers: who says which segment each is of."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey <= 200")
    t = F.concat(F.lit("<< <urn:d:customer:"), "c_custkey", F.lit('> <urn:p:segment> "'), "c_mktsegment", F.lit('" >>'))
    own = c.select(t.alias("s"), F.lit("<urn:p:saidBy>").alias("p"), F.concat(F.lit("<urn:d:nation:"), "c_nationkey", F.lit(">")).alias("o"), F.lit(None).cast("string").alias("g"))
    return QuadTable(own)


_register("quoted_pattern", "SELECT 'urn:d:customer:' || c_custkey AS c, c_mktsegment AS m, 'urn:d:nation:' || c_nationkey AS n FROM customer WHERE c_custkey <= 200")(
    lambda spark, sf_dir: typed(run(_claims(spark, sf_dir), parse_query(PREFIX + "SELECT ?c ?m ?n { << ?c p:segment ?m >> p:saidBy ?n }")), "c:iri m:str n:iri"))


@_register("annotations", "SELECT 'urn:d:nation:' || n_nationkey AS x, n_name AS n, 'atlas' AS b FROM nation")
def annotations(spark, sf_dir):
    """Annotation shorthand, written in Turtle and matched in a query."""
    text = TURTLE + "".join(f'<urn:d:nation:{k}> p:n_name "{n}" {{| p:by "atlas" |}} .\n' for k, n in nations(spark, sf_dir))
    g = GraphStore(spark)
    g.rdf_load_turtle(text)
    return typed(g.sparql(PREFIX + "SELECT ?x ?n ?b { ?x p:n_name ?n {| p:by ?b |} }"), "x:iri n:str b:str")


# --- rules, lists and deletion over graphs of a table's size ------------------------------------------------------------

_SAME = f"<{OWL}sameAs>"


def _customers(spark, sf_dir, *triples: tuple[str, str, str]) -> DataFrame:
    """(s, p, o) of templates over the customers: {{c}} is the key, {{n}} the nation's, {{m}} the segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")

    def cell(x: str):
        out = F.lit(x)
        for k, col in (("{c}", "c_custkey"), ("{n}", "c_nationkey"), ("{m}", "c_mktsegment")):
            out = F.replace(out, F.lit(k), F.col(col).cast("string"))
        return out

    return c.select(F.explode(F.array(*[F.struct(cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o")) for s, p, o in triples])).alias("t")).select("t.*")


def at_scale(name: str, rule: str, tbox: str, triples: list[tuple[str, str, str]], sql: str) -> None:
    def query(spark, sf_dir):
        u = _customers(spark, sf_dir, *triples)
        u = u.union(graph(spark, tbox).select("s", "p", "o")) if tbox else u
        return reasoner.rule(spark, rule, u.distinct()).select("s", "p", "o").distinct()

    _register("scale_" + name, sql)(query)


_C, _ACCOUNT, _LEDGER = "<urn:d:customer:{c}>", "<urn:d:account:{c}>", "<urn:d:ledger:{c}>"
_iri = lambda kind, key="c_custkey": f"'<urn:d:{kind}:' || {key} || '>'"
at_scale("eq_trans", "eq-trans", "", [(_C, _SAME, _ACCOUNT), (_ACCOUNT, _SAME, _LEDGER)], f"SELECT {_iri('customer')} AS s, '{_SAME}' AS p, {_iri('ledger')} AS o FROM customer")
at_scale("eq_sym", "eq-sym", "", [(_C, _SAME, _ACCOUNT)], f"SELECT {_iri('account')} AS s, '{_SAME}' AS p, {_iri('customer')} AS o FROM customer")
at_scale("eq_rep_s", "eq-rep-s", "", [(_C, _SAME, _ACCOUNT), (_C, "<urn:p:segment>", '"{m}"')], f"SELECT {_iri('account')} AS s, '<urn:p:segment>' AS p, '\"' || c_mktsegment || '\"' AS o FROM customer UNION ALL SELECT {_iri('account')}, '{_SAME}', {_iri('account')} FROM customer")
at_scale("prp_key", "prp-key", "c:Client owl:hasKey ( p:code ) .", [(_C, TYPE, "<urn:c:Client>"), (_C, "<urn:p:code>", '"{c}"'), (_ACCOUNT, TYPE, "<urn:c:Client>"), (_ACCOUNT, "<urn:p:code>", '"{c}"')],
         f"SELECT {_iri('customer')} AS s, '{_SAME}' AS p, {_iri('account')} AS o FROM customer UNION ALL SELECT {_iri('account')}, '{_SAME}', {_iri('customer')} FROM customer")
at_scale("prp_fp", "prp-fp", "r:holds a owl:FunctionalProperty .", [(_C, "<urn:r:holds>", _ACCOUNT), (_C, "<urn:r:holds>", _LEDGER)],
         f"SELECT {_iri('ledger')} AS s, '{_SAME}' AS p, {_iri('account')} AS o FROM customer UNION ALL SELECT {_iri('account')}, '{_SAME}', {_iri('ledger')} FROM customer")
at_scale("cls_maxc2", "cls-maxc2", 'c:Client owl:maxCardinality "1"^^xsd:nonNegativeInteger ; owl:onProperty r:holds .', [(_C, TYPE, "<urn:c:Client>"), (_C, "<urn:r:holds>", _ACCOUNT), (_C, "<urn:r:holds>", _LEDGER)],
         f"SELECT {_iri('ledger')} AS s, '{_SAME}' AS p, {_iri('account')} AS o FROM customer UNION ALL SELECT {_iri('account')}, '{_SAME}', {_iri('ledger')} FROM customer")
at_scale("prp_spo2", "prp-spo2", "r:third owl:propertyChainAxiom ( r:one r:two r:one ) .", [(_C, "<urn:r:one>", _ACCOUNT), (_ACCOUNT, "<urn:r:two>", _LEDGER), (_LEDGER, "<urn:r:one>", "<urn:d:nation:{n}>")],
         f"SELECT {_iri('customer')} AS s, '<urn:r:third>' AS p, {_iri('nation', 'c_nationkey')} AS o FROM customer")
at_scale("cls_oo", "cls-oo", "", [("<urn:c:Only:{c}>", f"<{OWL}oneOf>", "<urn:d:cell:{c}>"), ("<urn:d:cell:{c}>", f"<{RDF}first>", _C), ("<urn:d:cell:{c}>", f"<{RDF}rest>", f"<{RDF}nil>")],
         f"SELECT {_iri('customer')} AS s, '{TYPE}' AS p, '<urn:c:Only:' || c_custkey || '>' AS o FROM customer")
at_scale("scm_sco", "scm-sco", "", [("<urn:c:A:{c}>", f"<{RDFS}subClassOf>", "<urn:c:B:{n}>"), ("<urn:c:B:{n}>", f"<{RDFS}subClassOf>", "<urn:c:Top>")], f"SELECT '<urn:c:A:' || c_custkey || '>' AS s, '<{RDFS}subClassOf>' AS p, '<urn:c:Top>' AS o FROM customer")


def clash(name: str, rule: str, tbox: str, triples: list[tuple[str, str, str]], sql: str) -> None:
    def query(spark, sf_dir):
        u = _customers(spark, sf_dir, *triples)
        u = u.union(graph(spark, tbox).select("s", "p", "o")) if tbox else u
        return consistency.detect(u.distinct(), rule).drop("rule")

    _register("scale_" + name, sql)(query)


clash("prp_irp", "prp-irp", "r:likes a owl:IrreflexiveProperty .", [(_C, "<urn:r:likes>", "<urn:d:customer:{n}>")], f"SELECT {_iri('customer')} AS s, '<urn:r:likes>' AS p, {_iri('customer')} AS o FROM customer WHERE c_custkey = c_nationkey")
clash("prp_pdw", "prp-pdw", "r:owns owl:propertyDisjointWith r:owes .", [(_C, "<urn:r:owns>", _ACCOUNT), (_C, "<urn:r:owes>", "<urn:d:account:{n}>")], f"SELECT {_iri('customer')} AS s, '<urn:r:owes>' AS p, {_iri('account')} AS o FROM customer WHERE c_custkey = c_nationkey")
clash("eq_diff1", "eq-diff1", "", [(_C, _SAME, _ACCOUNT), (_ACCOUNT, f"<{OWL}differentFrom>", _C)], f"SELECT {_iri('account')} AS s, '{_SAME}' AS p, {_iri('customer')} AS o FROM customer")


@_register("scale_rdf_lists", "SELECT '<urn:d:cell:' || (c_nationkey + 1000) || ':0>' AS head, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS pos, '<urn:d:customer:' || c_custkey || '>' AS item, CAST(count(*) OVER (PARTITION BY c_nationkey) AS INT) AS n FROM customer")
def scale_rdf_lists(spark, sf_dir):
    """A list of all customers of each nation, walked."""
    w = Window.partitionBy("c_nationkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    cell = lambda i: F.concat(F.lit("<urn:d:cell:"), F.col("c_nationkey") + 1000, F.lit(":"), i, F.lit(">"))
    first = F.struct(cell(F.col("i")).alias("s"), F.lit(f"<{RDF}first>").alias("p"), F.concat(F.lit("<urn:d:customer:"), "c_custkey", F.lit(">")).alias("o"))
    rest = F.struct(cell(F.col("i")).alias("s"), F.lit(f"<{RDF}rest>").alias("p"), F.when(F.col("i") + 1 == F.col("n"), F.lit(f"<{RDF}nil>")).otherwise(cell(F.col("i") + 1)).alias("o"))
    u = c.select(F.explode(F.array(first, rest)).alias("t")).select("t.*")
    heads = c.where("i = 0").select(cell(F.col("i")).alias("head"))
    return lists.walk(u, heads).select("head", "pos", "item", "n")


@_register("scale_overdelete", f"SELECT 'derived' AS step, 3 * count(*) + 1 AS n FROM customer UNION ALL SELECT 'deleted', 2 * count(*) + 1 FROM customer UNION ALL SELECT 'left', count(*) FROM customer UNION ALL SELECT 'again', 0 UNION ALL SELECT 'index', count(*) FROM customer")
def scale_overdelete(spark, sf_dir):
    """Types of all customers derived with dependencies, an axiom retracted, and what is left in graph and index."""
    u = _customers(spark, sf_dir, (_C, TYPE, "<urn:c:Customer>"))
    u = u.union(graph(spark, "c:Customer rdfs:subClassOf c:Party, c:Payer . c:Party rdfs:subClassOf c:Agent .").select("s", "p", "o"))
    g = GraphStore(spark, u.withColumn("g", F.lit(None).cast("string")))
    of_data = lambda q: q.where("startswith(s, '<urn:d:customer:') OR s = '<urn:c:Customer>'").where(F.col("p").isin(TYPE, f"<{RDFS}subClassOf>"))
    g.rdf_owl_rl_materialise(None, "urn:g:i", {"track_dependencies": True})
    wanted = ("<urn:c:Party>", "<urn:c:Payer>", "<urn:c:Agent>")
    inferred = lambda: of_data(g.quads.where("g = '<urn:g:i>'")).where(F.col("o").isin(*wanted)).count()
    found = [("derived", inferred())]
    retract = json.dumps([["urn:c:Customer", f"{RDFS}subClassOf", "urn:c:Party"]])
    g.rdf_dred_overdelete("urn:g:i", retract)
    found += [("left", inferred()), ("deleted", found[0][1] - inferred()), ("again", g.rdf_dred_overdelete("urn:g:i", retract))]
    index = g.deps.where(F.col("inferred").contains("<urn:d:customer:") & F.col("inferred").contains(TYPE)).select("inferred").distinct().count()
    return rows(spark, [*found, ("index", index)])


# --- validation: report details ------------------------------------------------------------------------------------------


@_register("shacl_report_details", f"SELECT '<urn:d:S1>' AS shape, '<{SH}Violation>' AS severity, '<{SH}HasValueConstraintComponent>' AS component, count(*) AS n FROM customer WHERE c_nationkey <> 3")
def shacl_report_details(spark, sf_dir):
    """Source shape, severity (that of a shape isn't read) and component of every result in the report graph."""
    shapes = TURTLE + "d:S a sh:NodeShape ; sh:targetClass c:Customer ; sh:property d:S1 . d:S1 sh:path r:inNation ; sh:severity sh:Warning ; sh:hasValue <urn:d:nation:3> ."
    g = GraphStore(spark, quads(spark, sf_dir, ["customer"], [TYPE, "<urn:r:inNation>"]))
    g.rdf_load_turtle_to_graph(shapes, "urn:g:shapes")
    g.rdf_shacl_core_validate(None, "urn:g:shapes", "urn:g:report", {"max_violations": None})  # every result, however many
    q = "SELECT ?shape ?severity ?component (COUNT(*) AS ?n) { GRAPH <urn:g:report> { ?r sh:sourceShape ?shape ; sh:resultSeverity ?severity ; sh:sourceConstraintComponent ?component ; sh:focusNode ?f } } GROUP BY ?shape ?severity ?component"
    return typed(g.sparql(PREFIX + q), "shape:term severity:term component:term n:long")


@_register("shacl_provenance", "SELECT 'with' AS step, count(*) > 0 AS more FROM nation UNION ALL SELECT 'without', false")
def shacl_provenance(spark, sf_dir):
    """A report with provenance says more than one without."""
    shapes = TURTLE + "d:S a sh:NodeShape ; sh:targetClass c:Nation ; sh:property [ sh:path p:n_name ; sh:maxLength 3 ] ."
    sizes = []
    for raw in ({"provenance": True}, {}):
        g = GraphStore(spark, quads(spark, sf_dir, ["nation"], [TYPE, "<urn:p:n_name>"]))
        g.rdf_load_turtle_to_graph(shapes, "urn:g:shapes")
        g.rdf_shacl_core_validate(None, "urn:g:shapes", "urn:g:report", raw)
        sizes.append(g.rdf_count("urn:g:report"))
    return spark.createDataFrame([("with", sizes[0] > sizes[1]), ("without", sizes[1] > sizes[0])], "step string, more boolean")


for _kind, _bad in (("BlankNode", True), ("Literal", True), ("IRIOrLiteral", False), ("BlankNodeOrIRI", False), ("BlankNodeOrLiteral", True)):
    shape(f"node_kind_{_kind}", "customer", _CUST + f"sh:path r:inNation ; sh:nodeKind sh:{_kind} ] .", f"SELECT '<urn:d:customer:' || c_custkey || '>' AS focus, {_N} AS value, 'Value does not have nodeKind <{SH}{_kind}>' AS message FROM customer WHERE {str(_bad).lower()}")


@_register("shacl_class_by_subclass", "SELECT '<urn:d:customer:' || c_custkey || '>' AS focus FROM customer WHERE c_nationkey >= 10")
def shacl_class_by_subclass(spark, sf_dir):
    """Values that are instances of a class by way of its subclasses conform."""
    tbox = "c:Near rdfs:subClassOf c:Middle . c:Middle rdfs:subClassOf c:Place . " + " ".join(f"<urn:d:nation:{i}> a c:Near ." for i in range(10))
    data = quads(spark, sf_dir, ["customer"], [TYPE, "<urn:r:inNation>"]).union(graph(spark, tbox))
    return shacl.violations(data, parse_turtle(TURTLE + _CUST + "sh:path r:inNation ; sh:class c:Place ] ."), None).select(F.col("focusNode").alias("focus"))


# --- load and validation over several tables ----------------------------------------------------------------------------

_LOADED = {"orders": ("r:placedBy", "p:o_orderstatus", "p:o_totalprice", "p:o_orderdate", "p:o_orderpriority"), "customer": ("r:inNation", "p:c_name", "p:c_acctbal", "p:c_mktsegment"), "nation": ("r:inRegion", "p:n_name"), "region": ("p:r_name",)}


@_register("load_tables", " UNION ALL ".join(f"SELECT '<urn:{p}>' AS p, count(*) AS n FROM {t}" for t, own in _LOADED.items() for p in own) + f" UNION ALL SELECT '{TYPE}', sum(n)::BIGINT FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in _LOADED) + ")")
def load_tables(spark, sf_dir):
    """Four tables loaded into a store as quads; how many there are of each predicate."""
    return GraphStore(spark, quads(spark, sf_dir, list(_LOADED))).quads.groupBy("p").agg(F.count("*").alias("n"))


_FIVE = """d:C a sh:NodeShape ; sh:targetClass c:Customer ; sh:property [ sh:path p:c_mktsegment ; sh:in ( 'BUILDING' 'MACHINERY' ) ] , [ sh:path p:c_acctbal ; sh:minInclusive 0 ] ,
[ sh:path [ sh:inversePath r:placedBy ] ; sh:minCount 1 ] . d:O a sh:NodeShape ; sh:targetClass c:Order ; sh:property [ sh:path p:o_totalprice ; sh:maxInclusive 300000 ] , [ sh:path p:o_orderstatus ; sh:pattern '^[FO]$' ] ."""


@_register("shacl_five_shapes", """SELECT 'Value is not in the allowed sh:in list' AS message, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') HAVING count(*) > 0
UNION ALL SELECT 'Value is less than 0 or not comparable', count(*) FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 0 HAVING count(*) > 0
UNION ALL SELECT 'Less than 1 values on path (found 0)', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) HAVING count(*) > 0
UNION ALL SELECT 'Value is greater than 300000 or not comparable', count(*) FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 300000 HAVING count(*) > 0
UNION ALL SELECT 'Value does not match pattern "^[FO]$"', count(*) FROM orders WHERE NOT regexp_matches(o_orderstatus, '^[FO]$') HAVING count(*) > 0""")
def shacl_five_shapes(spark, sf_dir):
    """Five property shapes over customers and orders at once: results by message."""
    predicates = [TYPE, "<urn:r:placedBy>", "<urn:p:c_mktsegment>", "<urn:p:c_acctbal>", "<urn:p:o_totalprice>", "<urn:p:o_orderstatus>"]
    found = shacl.violations(quads(spark, sf_dir, ["customer", "orders"], predicates), parse_turtle(TURTLE + _FIVE), None)
    return found.groupBy(F.col("resultMessage").alias("message")).agg(F.count("*").alias("n"))
