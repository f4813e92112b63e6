"""Registered queries over the triplified tables, each with the same rows as relational SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.vocab import OWL, RDF, RDFS, SH, TYPE, XSD
from ..operators import closure, consistency, dred, lists, reasoner, shacl
from ..operators.store import GraphStore
from ..plans.compiler import QuadTable, run
from ..plans.parser import parse_query
from ..sources.triplify import dataset, quads
from ..sources.turtle import parse_turtle

PREFIX = f"PREFIX p: <urn:p:> PREFIX r: <urn:r:> PREFIX c: <urn:c:> PREFIX d: <urn:d:> PREFIX rdf: <{RDF}> PREFIX rdfs: <{RDFS}> PREFIX owl: <{OWL}> PREFIX xsd: <{XSD}> PREFIX sh: <{SH}> "
TURTLE = "".join(f"@{x.strip()} . " for x in PREFIX.replace("PREFIX", "@prefix").split("@")[1:])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CASTS = {"long": lambda c: T.lexical(c).cast("bigint"), "dec": lambda c: T.lexical(c).cast("decimal(18,2)"), "str": T.lexical, "iri": lambda c: F.regexp_replace(c, "^<|>$", ""), "term": lambda c: c, "bool": lambda c: T.lexical(c) == "true"}


def typed(df: DataFrame, spec: str) -> DataFrame:
    """Columns of encoded terms as plain values: 'name:kind ...'."""
    pairs = [x.split(":") for x in spec.split()]
    return df.select(*[_CASTS[k](F.col(n)).alias(n) for n, k in pairs])


def sparql(name: str, tables: str, text: str, spec: str, sql: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return typed(run(dataset(spark, sf_dir, tables.split()), parse_query(PREFIX + text)), spec)

    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def graph(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(*r, None) for r in parse_turtle(TURTLE + text)], "s string, p string, o string, g string")


def _values(text: str) -> str:
    rows = sorted(set(parse_turtle(TURTLE + text)))
    return "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(*[x.replace("'", "''") for x in r]) for r in rows) + ") v(s, p, o)"


# --- SPARQL patterns -------------------------------------------------------------------------------------------------

sparql("bgp_star", "customer nation region", "SELECT ?name (COUNT(*) AS ?n) { ?c r:inNation ?x . ?x r:inRegion ?r . ?r p:r_name ?name . ?c a c:Customer } GROUP BY ?name", "name:str n:long",
       "SELECT r_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("bgp_chain3", "orders customer nation", "SELECT ?n (COUNT(*) AS ?k) { ?o r:placedBy ?c . ?c r:inNation ?x . ?x p:n_name ?n } GROUP BY ?n", "n:str k:long",
       "SELECT n_name AS n, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
sparql("bgp_chain5", "lineitem orders customer nation region", "SELECT ?n (SUM(?e) AS ?total) { ?l r:ofOrder ?o ; p:l_extendedprice ?e . ?o r:placedBy ?c . ?c r:inNation ?x . ?x r:inRegion ?r . ?r p:r_name ?n } GROUP BY ?n", "n:str total:dec",
       "SELECT r_name AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM (SELECT DISTINCT * FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("bgp_repeat_var", "customer supplier", "SELECT ?x ?y { ?x r:inNation ?z . ?x ?y ?y }", "x:iri y:iri", "SELECT '' AS x, '' AS y WHERE false")
sparql("bgp_cross", "region", "SELECT ?a ?b { ?x p:r_name ?a . ?y p:r_name ?b }", "a:str b:str", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
sparql("bgp_const", "customer", "SELECT ?p ?o { <urn:d:customer:7> ?p ?o FILTER(isIRI(?o)) }", "p:iri o:iri", f"SELECT '{RDF}type' AS p, 'urn:c:Customer' AS o UNION ALL SELECT 'urn:r:inNation', 'urn:d:nation:' || c_nationkey FROM customer WHERE c_custkey = 7")
sparql("optional", "customer orders", "SELECT ?c (COUNT(?o) AS ?n) { ?c a c:Customer OPTIONAL { ?o r:placedBy ?c } } GROUP BY ?c", "c:iri n:long", "SELECT 'urn:d:customer:' || c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
sparql("optional_filter", "customer orders", "SELECT ?c (COUNT(?o) AS ?n) { ?c a c:Customer OPTIONAL { ?o r:placedBy ?c ; p:o_totalprice ?t FILTER(?t > 200000) } } GROUP BY ?c", "c:iri n:long",
       "SELECT 'urn:d:customer:' || c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND CAST(o_totalprice AS DECIMAL(18,2)) > 200000 GROUP BY 1")
sparql("union", "customer supplier", "SELECT ?n { { ?x p:c_name ?n } UNION { ?x p:s_name ?n } }", "n:str", "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier")
sparql("minus_shared", "customer orders", "SELECT ?c { ?c a c:Customer MINUS { ?o r:placedBy ?c } }", "c:iri", "SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sparql("minus_disjoint", "region customer", "SELECT ?n { ?r p:r_name ?n MINUS { ?a r:placedBy ?b } }", "n:str", "SELECT r_name AS n FROM region")
sparql("minus_unbound", "customer", "SELECT ?c ?a { ?c a c:Customer OPTIONAL { ?c p:c_acctbal ?a FILTER(?a < 0) } MINUS { ?c p:c_mktsegment 'BUILDING' ; p:c_acctbal ?a } }", "c:iri a:dec",
       "SELECT 'urn:d:customer:' || c_custkey AS c, CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) < 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS a FROM customer WHERE c_mktsegment <> 'BUILDING'")
sparql("exists", "customer orders", "SELECT ?c { ?c a c:Customer FILTER EXISTS { ?o r:placedBy ?c ; p:o_orderstatus 'F' } }", "c:iri", "SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
sparql("not_exists_correlated", "customer orders", "SELECT ?c { ?c p:c_acctbal ?b FILTER NOT EXISTS { ?o r:placedBy ?c ; p:o_totalprice ?t FILTER(?t > ?b) } }", "c:iri",
       "SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CAST(o_totalprice AS DECIMAL(18,2)) > CAST(c_acctbal AS DECIMAL(18,2)))")
sparql("exists_in_expression", "customer orders", "SELECT ?c { ?c p:c_mktsegment ?m FILTER(?m = 'BUILDING' || EXISTS { ?o r:placedBy ?c }) }", "c:iri", "SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders)")
sparql("values", "nation", "SELECT ?n ?k { VALUES (?n ?k) { ('FRANCE' 1) ('GERMANY' 2) (UNDEF 3) } ?x p:n_name ?n }", "n:str k:long", "SELECT n_name AS n, CAST(1 AS BIGINT) AS k FROM nation WHERE n_name = 'FRANCE' UNION ALL SELECT n_name, 2 FROM nation WHERE n_name = 'GERMANY' UNION ALL SELECT n_name, 3 FROM nation")
sparql("subselect", "orders customer", "SELECT ?m (MAX(?n) AS ?most) { ?c p:c_mktsegment ?m { SELECT ?c (COUNT(*) AS ?n) { ?o r:placedBy ?c } GROUP BY ?c } } GROUP BY ?m", "m:str most:long",
       "SELECT c_mktsegment AS m, max(n) AS most FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
sparql("compat_join", "customer", "SELECT ?c ?m { ?c a c:Customer OPTIONAL { ?c p:c_mktsegment ?m FILTER(?m = 'BUILDING') } VALUES ?m { 'BUILDING' } }", "c:iri m:str", "SELECT 'urn:d:customer:' || c_custkey AS c, 'BUILDING' AS m FROM customer")
sparql("bind", "part", "SELECT ?p ?b { ?p p:p_size ?s BIND(?s * 2 + 1 AS ?b) }", "p:iri b:long", "SELECT 'urn:d:part:' || p_partkey AS p, CAST(p_size * 2 + 1 AS BIGINT) AS b FROM part")
sparql("ask", "nation", "SELECT (COUNT(*) > 0 AS ?yes) { ?x p:n_name 'FRANCE' }", "yes:bool", "SELECT count(*) > 0 AS yes FROM nation WHERE n_name = 'FRANCE'")
sparql("filter_compare", "orders", "SELECT ?o { ?o p:o_totalprice ?t ; p:o_orderstatus ?s FILTER(?t >= 100000 && ?t < 150000.5 && ?s != 'O') }", "o:iri", "SELECT 'urn:d:order:' || o_orderkey AS o FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 100000 AND CAST(o_totalprice AS DECIMAL(18,2)) < 150000.5 AND o_orderstatus <> 'O'")
sparql("filter_in", "customer", "SELECT ?c { ?c p:c_mktsegment ?m FILTER(?m NOT IN ('BUILDING', 'MACHINERY')) }", "c:iri", "SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")

# --- modifiers and aggregates ----------------------------------------------------------------------------------------

sparql("distinct", "customer", "SELECT DISTINCT ?m { ?c p:c_mktsegment ?m }", "m:str", "SELECT DISTINCT c_mktsegment AS m FROM customer")
sparql("order_limit", "orders", "SELECT ?k ?t { ?k p:o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 20", "k:iri t:dec", "SELECT 'urn:d:order:' || o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders ORDER BY 2 DESC, 1 LIMIT 20")
sparql("offset", "nation", "SELECT ?n { ?x p:n_name ?n } ORDER BY ?n LIMIT 5 OFFSET 3", "n:str", "SELECT n_name AS n FROM nation ORDER BY 1 LIMIT 5 OFFSET 3")
sparql("having", "customer", "SELECT ?x (COUNT(*) AS ?n) { ?c r:inNation ?x ; a c:Customer } GROUP BY ?x HAVING(COUNT(*) > 50)", "x:iri n:long", "SELECT 'urn:d:nation:' || c_nationkey AS x, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 50")
sparql("project_expr", "customer", "SELECT ?c (UCASE(SUBSTR(?m, 1, 3)) AS ?u) { ?c p:c_mktsegment ?m }", "c:iri u:str", "SELECT 'urn:d:customer:' || c_custkey AS c, upper(substr(c_mktsegment, 1, 3)) AS u FROM customer")
sparql("group_by_expr", "orders", "SELECT ?y (COUNT(*) AS ?n) { ?o p:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "y:long n:long", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
sparql("count_distinct", "orders", "SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(*) AS ?k) { ?o r:placedBy ?c }", "n:long k:long", "SELECT count(DISTINCT o_custkey) AS n, count(*) AS k FROM orders")
sparql("aggregates", "orders", "SELECT ?s (SUM(?t) AS ?total) (MIN(?t) AS ?low) (MAX(?t) AS ?high) { ?o p:o_orderstatus ?s ; p:o_totalprice ?t } GROUP BY ?s", "s:str total:dec low:dec high:dec",
       "SELECT o_orderstatus AS s, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total, min(CAST(o_totalprice AS DECIMAL(18,2))) AS low, max(CAST(o_totalprice AS DECIMAL(18,2))) AS high FROM orders GROUP BY 1")
sparql("avg", "part", "SELECT ?b (FLOOR(AVG(?s) * 100) AS ?a) { ?x p:p_brand ?b ; p:p_size ?s } GROUP BY ?b", "b:str a:long", "SELECT p_brand AS b, CAST(sum(p_size) * 100 // count(*) AS BIGINT) AS a FROM part GROUP BY 1")
sparql("group_concat", "nation region", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?all) { ?x r:inRegion ?y ; p:n_name ?n . ?y p:r_name ?r } GROUP BY ?r", "r:str all:str", "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS \"all\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("implicit_group_empty", "nation", "SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?s) { ?x p:none ?k }", "n:long s:long", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s")
sparql("sample_min", "customer", "SELECT ?m (SAMPLE(?n) AS ?one) { ?c p:c_mktsegment ?m ; p:c_name ?n } GROUP BY ?m", "m:str one:str", "SELECT c_mktsegment AS m, min(c_name) AS one FROM customer GROUP BY 1")

# --- functions -------------------------------------------------------------------------------------------------------

sparql("str_functions", "customer", "SELECT ?c (STRLEN(?n) AS ?l) (LCASE(?n) AS ?w) (STRBEFORE(?n, '#') AS ?b) (STRAFTER(?n, '#') AS ?a) (CONCAT(?n, '!') AS ?x) (STRSTARTS(?n, 'C') AS ?s) (CONTAINS(?n, '00') AS ?k) { ?c p:c_name ?n }", "c:iri l:long w:str b:str a:str x:str s:bool k:bool",
       "SELECT 'urn:d:customer:' || c_custkey AS c, length(c_name) AS l, lower(c_name) AS w, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, 1, instr(c_name, '#') - 1) ELSE '' END AS b, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS a, c_name || '!' AS x, starts_with(c_name, 'C') AS s, contains(c_name, '00') AS k FROM customer")
sparql("num_functions", "orders", "SELECT ?o (ABS(?t - 100000) AS ?d) (CEIL(?t) AS ?c) (FLOOR(?t) AS ?f) (ROUND(?t) AS ?r) { ?o p:o_totalprice ?t }", "o:iri d:dec c:long f:long r:long",
       "SELECT 'urn:d:order:' || o_orderkey AS o, CAST(abs(t - 100000) AS DECIMAL(18,2)) AS d, CAST(ceil(t) AS BIGINT) AS c, CAST(floor(t) AS BIGINT) AS f, CAST(floor(t + 0.5) AS BIGINT) AS r FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders)")
sparql("date_functions", "orders", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) { ?o p:o_orderdate ?d }", "o:iri y:long m:long k:long h:long",
       "SELECT 'urn:d:order:' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS k, hour(o_orderdate) AS h FROM orders")
sparql("date_compare", "orders", "SELECT (COUNT(*) AS ?n) { ?o p:o_orderdate ?d FILTER(?d >= '1995-06-01T00:00:00'^^xsd:dateTime) }", "n:long", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00'")
sparql("hash_functions", "nation", "SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?s) (SHA256(?n) AS ?t) { ?x p:n_name ?n }", "n:str m:str s:str t:str", "SELECT n_name AS n, md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS t FROM nation")
sparql("regex_replace", "part", "SELECT ?p (REPLACE(?n, '[aeiou]', '*') AS ?r) { ?p p:p_name ?n FILTER(REGEX(?n, 'A', 'i')) }", "p:iri r:str", "SELECT 'urn:d:part:' || p_partkey AS p, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r FROM part WHERE regexp_matches(p_name, 'a', 'i')")
sparql("if_coalesce", "part", "SELECT ?p (IF(?s > 25, 'big', 'small') AS ?k) (COALESCE(?none, ?s / 0, ?s) AS ?v) { ?p p:p_size ?s }", "p:iri k:str v:long", "SELECT 'urn:d:part:' || p_partkey AS p, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS k, CAST(p_size AS BIGINT) AS v FROM part")
sparql("term_tests", "nation", "SELECT ?p (isIRI(?o) AS ?i) (isLiteral(?o) AS ?l) (isNumeric(?o) AS ?n) (COUNT(*) AS ?k) { ?s ?p ?o } GROUP BY ?p (isIRI(?o)) (isLiteral(?o)) (isNumeric(?o))", "p:iri i:bool l:bool n:bool k:long",
       f"SELECT '{RDF}type' AS p, true AS i, false AS l, false AS n, count(*) AS k FROM nation UNION ALL SELECT 'urn:r:inRegion', true, false, false, count(*) FROM nation UNION ALL SELECT 'urn:p:n_name', false, true, false, count(*) FROM nation")
sparql("casts_datatype", "part", "SELECT ?p (xsd:integer(?r) AS ?i) (STR(DATATYPE(?r)) AS ?d) (xsd:string(?s) AS ?t) { ?p p:p_retailprice ?r ; p:p_size ?s }", "p:iri i:long d:str t:str",
       f"SELECT 'urn:d:part:' || p_partkey AS p, CAST(trunc(CAST(p_retailprice AS DECIMAL(18,2))) AS BIGINT) AS i, '{XSD}decimal' AS d, CAST(p_size AS VARCHAR) AS t FROM part")
sparql("rdf_star_functions", "nation", "SELECT ?n (STR(SUBJECT(?t)) AS ?s) (OBJECT(?t) AS ?o) { ?x p:n_name ?n BIND(TRIPLE(?x, p:n_name, ?n) AS ?t) FILTER(isTRIPLE(?t)) }", "n:str s:str o:str", "SELECT n_name AS n, 'urn:d:nation:' || n_nationkey AS s, n_name AS o FROM nation")

# --- paths -----------------------------------------------------------------------------------------------------------

sparql("path_seq", "orders customer nation", "SELECT ?o ?n { ?o r:placedBy/r:inNation/p:n_name ?n }", "o:iri n:str", "SELECT 'urn:d:order:' || o_orderkey AS o, n_name AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
sparql("path_alt", "customer nation", "SELECT ?x ?y { ?x r:inNation|r:inRegion ?y }", "x:iri y:iri", "SELECT 'urn:d:customer:' || c_custkey AS x, 'urn:d:nation:' || c_nationkey AS y FROM customer UNION ALL SELECT 'urn:d:nation:' || n_nationkey, 'urn:d:region:' || n_regionkey FROM nation")
sparql("path_inv", "orders", "SELECT ?c (COUNT(*) AS ?n) { ?c ^r:placedBy ?o } GROUP BY ?c", "c:iri n:long", "SELECT 'urn:d:customer:' || o_custkey AS c, count(*) AS n FROM orders GROUP BY 1")
sparql("path_opt", "nation", "SELECT ?y { <urn:d:nation:3> r:inRegion? ?y }", "y:iri", "SELECT 'urn:d:nation:3' AS y UNION ALL SELECT 'urn:d:region:' || n_regionkey FROM nation WHERE n_nationkey = 3")
sparql("path_star", "supplier nation", "SELECT ?y { <urn:d:supplier:1> (r:inNation|r:inRegion)* ?y }", "y:iri", "SELECT 'urn:d:supplier:1' AS y UNION ALL SELECT 'urn:d:nation:' || s_nationkey FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 'urn:d:region:' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1")
sparql("path_plus", "customer nation", "SELECT ?x ?y { ?x (r:inNation|r:inRegion)+ ?y }", "x:iri y:iri",
       "WITH e AS (SELECT 'urn:d:customer:' || c_custkey AS x, 'urn:d:nation:' || c_nationkey AS y FROM customer UNION SELECT 'urn:d:nation:' || n_nationkey, 'urn:d:region:' || n_regionkey FROM nation) SELECT x, y FROM e UNION SELECT a.x, b.y FROM e a JOIN e b ON a.y = b.x")
sparql("path_neg", "nation", "SELECT ?x ?y { ?x !(rdf:type|p:n_name) ?y }", "x:iri y:iri", "SELECT 'urn:d:nation:' || n_nationkey AS x, 'urn:d:region:' || n_regionkey AS y FROM nation")

# --- datasets, construct, update, terms ------------------------------------------------------------------------------


def _register(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _named(spark, sf_dir) -> DataFrame:
    """nation in the default graph, customers in one graph per market segment."""
    n = quads(spark, sf_dir, ["nation"])
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("<urn:d:customer:"), "c_custkey", F.lit(">")).alias("s"), F.lit("<urn:r:inNation>").alias("p"), F.concat(F.lit("<urn:d:nation:"), "c_nationkey", F.lit(">")).alias("o"), F.concat(F.lit("<urn:g:"), "c_mktsegment", F.lit(">")).alias("g"))
    return n.union(c)


def named(name: str, text: str, spec: str, sql: str) -> None:
    _register(name, sql)(lambda spark, sf_dir: typed(run(QuadTable(_named(spark, sf_dir)), parse_query(PREFIX + text)), spec))


named("graph_const", "SELECT ?c { GRAPH <urn:g:BUILDING> { ?c r:inNation ?n } }", "c:iri", "SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
named("graph_var", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?c r:inNation ?x } } GROUP BY ?g", "g:iri n:long", "SELECT 'urn:g:' || c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1")
named("from_merge", "SELECT (COUNT(*) AS ?n) FROM <urn:g:BUILDING> FROM <urn:g:MACHINERY> { ?c r:inNation ?x }", "n:long", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
named("default_only", "SELECT (COUNT(*) AS ?n) { ?x r:inNation ?y }", "n:long", "SELECT CAST(0 AS BIGINT) AS n")
named("graph_join", "SELECT ?c ?name { GRAPH <urn:g:BUILDING> { ?c r:inNation ?n } ?n p:n_name ?name }", "c:iri name:str", "SELECT 'urn:d:customer:' || c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")


@_register("construct_dedup", "SELECT DISTINCT '<urn:d:nation:' || c_nationkey || '>' AS s, '<urn:r:hasSegment>' AS p, '\"' || c_mktsegment || '\"' AS o FROM customer")
def construct_dedup(spark, sf_dir):
    return run(dataset(spark, sf_dir, ["customer"]), parse_query(PREFIX + "CONSTRUCT { ?n r:hasSegment ?m } WHERE { ?c r:inNation ?n ; p:c_mktsegment ?m }"))


@_register("describe", f"SELECT '<urn:d:nation:5>' AS s, '{TYPE}' AS p, '<urn:c:Nation>' AS o UNION ALL SELECT '<urn:d:nation:5>', '<urn:p:n_name>', '\"' || n_name || '\"' FROM nation WHERE n_nationkey = 5 UNION ALL SELECT '<urn:d:nation:5>', '<urn:r:inRegion>', '<urn:d:region:' || n_regionkey || '>' FROM nation WHERE n_nationkey = 5")
def describe(spark, sf_dir):
    return run(dataset(spark, sf_dir, ["nation"]), parse_query("DESCRIBE <urn:d:nation:5>"))


@_register("dump_ntriples", "SELECT '<urn:d:region:' || r_regionkey || '> <urn:p:r_name> \"' || r_name || '\" .' AS value FROM region")
def dump_ntriples(spark, sf_dir):
    return GraphStore(spark, quads(spark, sf_dir, ["region"], ["<urn:p:r_name>"])).dump_df()


@_register("dump_escapes", "SELECT '<urn:d:document:' || doc_id || '> <urn:p:text> \"' || replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r') || '\" .' AS value FROM documents")
def dump_escapes(spark, sf_dir):
    q = quads(spark, sf_dir, ["documents"], ["<urn:p:text>"])
    return q.select(F.concat_ws(" ", *[T.to_ntriples(F.col(c)) for c in "spo"], F.lit(".")).alias("value"))


@_register("term_functions", "SELECT 'iri' AS kind, 'urn:d:nation:' || n_nationkey AS value FROM nation UNION ALL SELECT 'literal', n_name FROM nation")
def term_functions(spark, sf_dir):
    q = quads(spark, sf_dir, ["nation"], ["<urn:p:n_name>"])
    t = q.select(F.explode(F.array("s", "o")).alias("t"))
    return t.select(T.term_type(F.col("t")).alias("kind"), T.term_value(F.col("t")).alias("value"))


def _stored(spark, sf_dir) -> GraphStore:
    return GraphStore(spark, quads(spark, sf_dir, ["customer", "nation"], ["<urn:r:inNation>", "<urn:p:c_mktsegment>", "<urn:p:n_name>"]))


def update(name: str, text: str, sql: str) -> None:
    """After an update: its delta, and the number of triples by predicate."""

    def query(spark, sf_dir):
        store = _stored(spark, sf_dir)
        delta = store.sparql_update(PREFIX + text)
        return store.quads.groupBy("p").agg(F.count("*").alias("n"), F.lit(delta).cast("bigint").alias("delta"))

    _register(name, sql)(query)


_BASE = "SELECT '<urn:r:inNation>' AS p, count(*) AS n FROM customer UNION ALL SELECT '<urn:p:n_name>', count(*) FROM nation"
update("insert_data_dedup", "INSERT DATA { <urn:d:customer:1> p:note 'x' , 'x' , 'y' }", f"SELECT p, n, CAST(2 AS BIGINT) AS delta FROM ({_BASE} UNION ALL SELECT '<urn:p:c_mktsegment>', count(*) FROM customer UNION ALL SELECT '<urn:p:note>', 2)")
update("delete_where", "DELETE WHERE { ?c p:c_mktsegment 'BUILDING' }", f"SELECT p, n, (SELECT -count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS delta FROM ({_BASE} UNION ALL SELECT '<urn:p:c_mktsegment>', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING')")
update("modify", "DELETE { ?c p:c_mktsegment ?m } INSERT { ?c p:segment ?m } WHERE { ?c p:c_mktsegment ?m FILTER(?m = 'BUILDING') }", f"SELECT p, n, CAST(0 AS BIGINT) AS delta FROM ({_BASE} UNION ALL SELECT '<urn:p:c_mktsegment>', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT '<urn:p:segment>', count(*) FROM customer WHERE c_mktsegment = 'BUILDING')")
update("insert_where_graph", "INSERT { GRAPH <urn:g:x> { ?n r:home ?c } } WHERE { ?c r:inNation ?n }", f"SELECT p, n, (SELECT count(*) FROM customer) AS delta FROM ({_BASE} UNION ALL SELECT '<urn:p:c_mktsegment>', count(*) FROM customer UNION ALL SELECT '<urn:r:home>', count(*) FROM customer)")
update("copy_clear_graph", "COPY DEFAULT TO <urn:g:y> ; CLEAR DEFAULT", f"SELECT p, n, CAST(0 AS BIGINT) AS delta FROM ({_BASE} UNION ALL SELECT '<urn:p:c_mktsegment>', count(*) FROM customer)")


@_register("insert_many_dedup", "SELECT CAST(count(*) AS BIGINT) AS added, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS total FROM supplier")
def insert_many_dedup(spark, sf_dir):
    store = GraphStore(spark, quads(spark, sf_dir, ["customer"], ["<urn:r:inNation>"]))
    more = quads(spark, sf_dir, ["customer", "supplier"], ["<urn:r:inNation>"])
    return spark.createDataFrame([(store.insert_df(more), store.rdf_count_all())], "added bigint, total bigint")


@_register("delete_many", "SELECT count(*) FILTER (c_nationkey < 10) AS removed, count(*) FILTER (c_nationkey >= 10) AS total FROM customer")
def delete_many(spark, sf_dir):
    q = quads(spark, sf_dir, ["customer"], ["<urn:r:inNation>"])
    store = GraphStore(spark, q)
    removed = store.delete_df(q.where(F.regexp_extract("o", "([0-9]+)>$", 1).cast("int") < 10))
    return spark.createDataFrame([(removed, store.rdf_count_all())], "removed bigint, total bigint")


# --- rules: a T-Box, tables, and what the rule alone derives -----------------------------------------------------------

_CUSTOMERS = "SELECT '<urn:d:customer:' || c_custkey || '>' AS s"
_TYPES = (["customer"], [TYPE])
_NATIONS = (["customer"], ["<urn:r:inNation>"])


def derived(name: str, tbox: str, abox: tuple | None, sql: str) -> None:
    def query(spark, sf_dir):
        u = graph(spark, tbox) if tbox else None
        if abox:
            a = quads(spark, sf_dir, *abox)
            u = a if u is None else u.union(a)
        return reasoner.rule(spark, name, u.select("s", "p", "o").distinct()).select("s", "p", "o").distinct()

    _register("rule_" + name.replace("-", "_"), sql if sql.startswith("SELECT") or sql.startswith("WITH") else _values(sql))(query)


def _of_customers(p: str, o: str, table: str = "customer") -> str:
    return f"SELECT DISTINCT '<urn:d:customer:' || c_custkey || '>' AS s, '{p}' AS p, {o} AS o FROM {table}"


_N = "'<urn:d:nation:' || c_nationkey || '>'"
_LIST_OF = "SELECT DISTINCT '<urn:d:nation:' || c_nationkey || '>' AS s, "
derived("scm-sco", "c:A rdfs:subClassOf c:B . c:B rdfs:subClassOf c:C .", None, "c:A rdfs:subClassOf c:C .")
derived("scm-spo", "r:a rdfs:subPropertyOf r:b . r:b rdfs:subPropertyOf r:c .", None, "r:a rdfs:subPropertyOf r:c .")
derived("scm-eqc1", "c:A owl:equivalentClass c:B .", None, "c:A rdfs:subClassOf c:B . c:B rdfs:subClassOf c:A .")
derived("scm-eqp1", "r:a owl:equivalentProperty r:b .", None, "r:a rdfs:subPropertyOf r:b . r:b rdfs:subPropertyOf r:a .")
derived("cax-sco", "c:Customer rdfs:subClassOf c:Party .", _TYPES, _of_customers(TYPE, "'<urn:c:Party>'"))
derived("prp-spo1", "r:inNation rdfs:subPropertyOf r:locatedIn .", _NATIONS, _of_customers("<urn:r:locatedIn>", _N))
derived("prp-dom", "r:inNation rdfs:domain c:Located .", _NATIONS, _of_customers(TYPE, "'<urn:c:Located>'"))
derived("prp-rng", "r:inNation rdfs:range c:Place .", _NATIONS, f"{_LIST_OF} '{TYPE}' AS p, '<urn:c:Place>' AS o FROM customer")
derived("prp-trp", "r:inNation a owl:TransitiveProperty . " + " ".join(f"<urn:d:nation:{i}> r:inNation <urn:d:world:1> ." for i in range(25)), _NATIONS, _of_customers("<urn:r:inNation>", "'<urn:d:world:1>'"))
derived("prp-symp", "r:inNation a owl:SymmetricProperty .", _NATIONS, "SELECT '<urn:d:nation:' || c_nationkey || '>' AS s, '<urn:r:inNation>' AS p, '<urn:d:customer:' || c_custkey || '>' AS o FROM customer")
derived("prp-inv1", "r:inNation owl:inverseOf r:home .", _NATIONS, "SELECT '<urn:d:nation:' || c_nationkey || '>' AS s, '<urn:r:home>' AS p, '<urn:d:customer:' || c_custkey || '>' AS o FROM customer")
derived("prp-inv2", "r:home owl:inverseOf r:inNation .", _NATIONS, "SELECT '<urn:d:nation:' || c_nationkey || '>' AS s, '<urn:r:home>' AS p, '<urn:d:customer:' || c_custkey || '>' AS o FROM customer")
derived("prp-fp", "r:inRegion a owl:FunctionalProperty . <urn:d:nation:0> r:inRegion <urn:d:region:99> .", (["nation"], ["<urn:r:inRegion>"]), "SELECT '<urn:d:region:99>' AS s, '<http://www.w3.org/2002/07/owl#sameAs>' AS p, '<urn:d:region:' || n_regionkey || '>' AS o FROM nation WHERE n_nationkey = 0 UNION ALL SELECT '<urn:d:region:' || n_regionkey || '>', '<http://www.w3.org/2002/07/owl#sameAs>', '<urn:d:region:99>' FROM nation WHERE n_nationkey = 0")
derived("eq-sym", "d:a owl:sameAs d:b .", None, "d:b owl:sameAs d:a .")
derived("eq-trans", "d:a owl:sameAs d:b . d:b owl:sameAs d:c .", None, "d:a owl:sameAs d:c .")
derived("scm-cls", "c:A a owl:Class .", None, "c:A rdfs:subClassOf c:A, owl:Thing ; owl:equivalentClass c:A . owl:Nothing rdfs:subClassOf c:A .")
derived("scm-op", "r:a a owl:ObjectProperty .", None, "r:a rdfs:subPropertyOf r:a ; owl:equivalentProperty r:a .")
derived("scm-dp", "r:a a owl:DatatypeProperty .", None, "r:a rdfs:subPropertyOf r:a ; owl:equivalentProperty r:a .")
derived("scm-eqc2", "c:A rdfs:subClassOf c:B . c:B rdfs:subClassOf c:A .", None, "c:A owl:equivalentClass c:B . c:B owl:equivalentClass c:A .")
derived("scm-eqp2", "r:a rdfs:subPropertyOf r:b . r:b rdfs:subPropertyOf r:a .", None, "r:a owl:equivalentProperty r:b . r:b owl:equivalentProperty r:a .")
derived("scm-dom1", "r:a rdfs:domain c:A . c:A rdfs:subClassOf c:B .", None, "r:a rdfs:domain c:B .")
derived("scm-dom2", "r:b rdfs:domain c:A . r:a rdfs:subPropertyOf r:b .", None, "r:a rdfs:domain c:A .")
derived("scm-rng1", "r:a rdfs:range c:A . c:A rdfs:subClassOf c:B .", None, "r:a rdfs:range c:B .")
derived("scm-rng2", "r:b rdfs:range c:A . r:a rdfs:subPropertyOf r:b .", None, "r:a rdfs:range c:A .")
derived("scm-hv", "c:A owl:hasValue d:v ; owl:onProperty r:a . c:B owl:hasValue d:v ; owl:onProperty r:b . r:a rdfs:subPropertyOf r:b .", None, "c:A rdfs:subClassOf c:B .")
derived("scm-svf1", "c:A owl:someValuesFrom c:X ; owl:onProperty r:a . c:B owl:someValuesFrom c:Y ; owl:onProperty r:a . c:X rdfs:subClassOf c:Y .", None, "c:A rdfs:subClassOf c:B .")
derived("scm-svf2", "c:A owl:someValuesFrom c:X ; owl:onProperty r:a . c:B owl:someValuesFrom c:X ; owl:onProperty r:b . r:a rdfs:subPropertyOf r:b .", None, "c:A rdfs:subClassOf c:B .")
derived("scm-avf1", "c:A owl:allValuesFrom c:X ; owl:onProperty r:a . c:B owl:allValuesFrom c:Y ; owl:onProperty r:a . c:X rdfs:subClassOf c:Y .", None, "c:A rdfs:subClassOf c:B .")
derived("scm-avf2", "c:A owl:allValuesFrom c:X ; owl:onProperty r:a . c:B owl:allValuesFrom c:X ; owl:onProperty r:b . r:a rdfs:subPropertyOf r:b .", None, "c:B rdfs:subClassOf c:A .")
derived("scm-int", "c:A owl:intersectionOf ( c:X c:Y ) .", None, "c:A rdfs:subClassOf c:X, c:Y .")
derived("scm-uni", "c:A owl:unionOf ( c:X c:Y ) .", None, "c:X rdfs:subClassOf c:A . c:Y rdfs:subClassOf c:A .")
derived("cls-thing", "c:A a c:B .", None, "owl:Thing a owl:Class .")
derived("cls-nothing1", "c:A a c:B .", None, "owl:Nothing a owl:Class .")
derived("cls-int1", "c:Both owl:intersectionOf ( c:Customer c:Vip ) . <urn:d:customer:1> a c:Vip . <urn:d:customer:2> a c:Vip . <urn:d:x:1> a c:Vip .", _TYPES, f"{_CUSTOMERS}, '{TYPE}' AS p, '<urn:c:Both>' AS o FROM customer WHERE c_custkey IN (1, 2)")
derived("cls-int2", "c:Customer owl:intersectionOf ( c:Person c:Payer ) .", _TYPES, f"{_CUSTOMERS}, '{TYPE}' AS p, '<urn:c:Person>' AS o FROM customer UNION ALL {_CUSTOMERS}, '{TYPE}', '<urn:c:Payer>' FROM customer")
derived("cls-uni", "c:Party owl:unionOf ( c:Customer c:Supplier ) .", (["customer", "supplier"], [TYPE]), f"{_CUSTOMERS}, '{TYPE}' AS p, '<urn:c:Party>' AS o FROM customer UNION ALL SELECT '<urn:d:supplier:' || s_suppkey || '>', '{TYPE}', '<urn:c:Party>' FROM supplier")
derived("cls-svf1", "c:Resident owl:someValuesFrom c:Big ; owl:onProperty r:inNation . <urn:d:nation:3> a c:Big .", _NATIONS, f"{_CUSTOMERS}, '{TYPE}' AS p, '<urn:c:Resident>' AS o FROM customer WHERE c_nationkey = 3")
derived("cls-svf2", "c:Resident owl:someValuesFrom owl:Thing ; owl:onProperty r:inNation .", _NATIONS, _of_customers(TYPE, "'<urn:c:Resident>'"))
derived("cls-avf", "c:Customer owl:allValuesFrom c:Place ; owl:onProperty r:inNation .", (["customer"], [TYPE, "<urn:r:inNation>"]), f"{_LIST_OF} '{TYPE}' AS p, '<urn:c:Place>' AS o FROM customer")
derived("cls-hv1", "c:Customer owl:hasValue d:yes ; owl:onProperty r:active .", _TYPES, _of_customers("<urn:r:active>", "'<urn:d:yes>'"))
derived("cls-hv2", "c:French owl:hasValue <urn:d:nation:6> ; owl:onProperty r:inNation .", _NATIONS, f"{_CUSTOMERS}, '{TYPE}' AS p, '<urn:c:French>' AS o FROM customer WHERE c_nationkey = 6")
_AB = "d:a owl:sameAs d:b . d:b owl:sameAs d:a ."
derived("cls-maxc2", 'c:C owl:maxCardinality "1"^^xsd:nonNegativeInteger ; owl:onProperty r:p . d:x a c:C ; r:p d:a, d:b .', None, _AB)
derived("cls-maxqc3", 'c:C owl:maxQualifiedCardinality "1"^^xsd:nonNegativeInteger ; owl:onProperty r:p ; owl:onClass c:D . d:x a c:C ; r:p d:a, d:b, d:e . d:a a c:D . d:b a c:D .', None, _AB)
derived("cls-maxqc4", 'c:C owl:maxQualifiedCardinality "1"^^xsd:nonNegativeInteger ; owl:onProperty r:p ; owl:onClass owl:Thing . d:x a c:C ; r:p d:a, d:b .', None, _AB)
derived("cls-oo", "c:Seasons owl:oneOf ( d:spring d:autumn ) .", None, "d:spring a c:Seasons . d:autumn a c:Seasons .")
derived("cax-eqc1", "c:Customer owl:equivalentClass c:Client .", _TYPES, _of_customers(TYPE, "'<urn:c:Client>'"))
derived("cax-eqc2", "c:Client owl:equivalentClass c:Customer .", _TYPES, _of_customers(TYPE, "'<urn:c:Client>'"))
derived("prp-ifp", "p:n_name a owl:InverseFunctionalProperty . d:copy p:n_name 'FRANCE' .", (["nation"], ["<urn:p:n_name>"]), "SELECT '<urn:d:copy>' AS s, '<http://www.w3.org/2002/07/owl#sameAs>' AS p, '<urn:d:nation:' || n_nationkey || '>' AS o FROM nation WHERE n_name = 'FRANCE' UNION ALL SELECT '<urn:d:nation:' || n_nationkey || '>', '<http://www.w3.org/2002/07/owl#sameAs>', '<urn:d:copy>' FROM nation WHERE n_name = 'FRANCE'")
derived("prp-spo2", "r:customerRegion owl:propertyChainAxiom ( r:inNation r:inRegion ) .", (["customer", "nation"], ["<urn:r:inNation>", "<urn:r:inRegion>"]), "SELECT '<urn:d:customer:' || c_custkey || '>' AS s, '<urn:r:customerRegion>' AS p, '<urn:d:region:' || n_regionkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
derived("prp-eqp1", "r:inNation owl:equivalentProperty r:country .", _NATIONS, _of_customers("<urn:r:country>", _N))
derived("prp-eqp2", "r:country owl:equivalentProperty r:inNation .", _NATIONS, _of_customers("<urn:r:country>", _N))
derived("prp-key", "c:Nation owl:hasKey ( p:n_name r:inRegion ) . d:copy a c:Nation ; p:n_name 'FRANCE' ; r:inRegion d:nowhere . d:twin a c:Nation ; p:n_name 'X' ; r:inRegion d:here . d:twin2 a c:Nation ; p:n_name 'X', 'Y' ; r:inRegion d:here .", (["nation"], [TYPE, "<urn:p:n_name>", "<urn:r:inRegion>"]), "d:twin owl:sameAs d:twin2 . d:twin2 owl:sameAs d:twin .")
derived("eq-ref", "d:a r:p d:b ; r:q 'x' .", None, "d:a owl:sameAs d:a . d:b owl:sameAs d:b . r:p owl:sameAs r:p . r:q owl:sameAs r:q .")
derived("eq-rep-s", "<urn:d:customer:1> owl:sameAs d:one .", _NATIONS, "SELECT '<urn:d:one>' AS s, '<urn:r:inNation>' AS p, '<urn:d:nation:' || c_nationkey || '>' AS o FROM customer WHERE c_custkey = 1 UNION ALL SELECT '<urn:d:one>', '<http://www.w3.org/2002/07/owl#sameAs>', '<urn:d:one>'")
derived("eq-rep-p", "r:inNation owl:sameAs r:country .", _NATIONS, _of_customers("<urn:r:country>", _N))
derived("eq-rep-o", "<urn:d:nation:6> owl:sameAs d:france .", _NATIONS, "SELECT '<urn:d:customer:' || c_custkey || '>' AS s, '<urn:r:inNation>' AS p, '<urn:d:france>' AS o FROM customer WHERE c_nationkey = 6")
derived("dt-type1", "d:a r:p d:b .", None, " ".join(f"{x} a rdfs:Datatype ." for x in (
    "rdf:PlainLiteral rdf:XMLLiteral xsd:anyURI xsd:base64Binary xsd:boolean xsd:byte xsd:dateTime xsd:dateTimeStamp xsd:decimal xsd:double xsd:float xsd:hexBinary xsd:int xsd:integer xsd:language xsd:long "
    "xsd:Name xsd:NCName xsd:NMTOKEN xsd:negativeInteger xsd:nonNegativeInteger xsd:nonPositiveInteger xsd:normalizedString xsd:positiveInteger xsd:short xsd:string xsd:token xsd:unsignedByte xsd:unsignedInt xsd:unsignedLong xsd:unsignedShort"
).split()))
derived("dt-type2", "d:a r:p 'x'@en .", (["part"], ["<urn:p:p_size>", "<urn:p:p_name>"]), "rdf:langString a rdfs:Datatype . xsd:integer a rdfs:Datatype . xsd:string a rdfs:Datatype .")
derived("dt-eq", "d:a r:p 1 .", None, "SELECT '' AS s, '' AS p, '' AS o WHERE false")
derived("dt-diff", "d:a r:p 1 .", None, "SELECT '' AS s, '' AS p, '' AS o WHERE false")

_TBOX = "c:Customer rdfs:subClassOf c:Party . c:Supplier rdfs:subClassOf c:Party . c:Party rdfs:subClassOf c:Agent . r:inNation rdfs:subPropertyOf r:locatedIn . r:inRegion rdfs:subPropertyOf r:locatedIn . r:locatedIn a owl:TransitiveProperty ."


@_register("owl_closure_full", f"""WITH RECURSIVE e AS (SELECT '<urn:d:supplier:' || s_suppkey || '>' AS s, '<urn:d:nation:' || s_nationkey || '>' AS o FROM supplier UNION SELECT '<urn:d:nation:' || n_nationkey || '>', '<urn:d:region:' || n_regionkey || '>' FROM nation),
t(s, o) AS (SELECT s, o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s)
SELECT s, '<urn:r:locatedIn>' AS p, o FROM t UNION ALL SELECT '<urn:d:supplier:' || s_suppkey || '>', '{TYPE}', c FROM supplier, (VALUES ('<urn:c:Party>'), ('<urn:c:Agent>')) v(c)""")
def owl_closure_full(spark, sf_dir):
    """New triples about the data that the fixpoint of all rules adds."""
    a = quads(spark, sf_dir, ["supplier", "nation"], [TYPE, "<urn:r:inNation>", "<urn:r:inRegion>"]).where("NOT startswith(o, '<urn:c:Nation')").union(graph(spark, _TBOX))
    found = reasoner.materialise(a, a.where(F.lit(False))).new
    return found.where(F.col("s").startswith("<urn:d:"))


@_register("closure_pairs", "WITH RECURSIVE e AS (SELECT DISTINCT '<urn:d:customer:' || c_custkey || '>' AS s, '<urn:d:nation:' || c_nationkey || '>' AS o FROM customer UNION SELECT '<urn:d:nation:' || n_nationkey || '>', '<urn:d:region:' || n_regionkey || '>' FROM nation), t(s, o) AS (SELECT s, o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) SELECT s, o FROM t")
def closure_pairs(spark, sf_dir):
    return closure.transitive(quads(spark, sf_dir, ["customer", "nation"], ["<urn:r:inNation>", "<urn:r:inRegion>"]).select("s", "o"))


@_register("rdf_lists", "SELECT * FROM (VALUES ('<urn:d:l1>', 0, '<urn:d:a>', 2), ('<urn:d:l1>', 1, '<urn:d:b>', 2)) v(head, pos, item, n)")
def rdf_lists(spark, sf_dir):
    u = graph(spark, "d:x owl:unionOf d:l1 . d:l1 rdf:first d:a ; rdf:rest d:l2 . d:l2 rdf:first d:b ; rdf:rest rdf:nil . d:y owl:unionOf d:bad . d:bad rdf:first d:a, d:b ; rdf:rest rdf:nil . d:z owl:unionOf d:loop . d:loop rdf:first d:a ; rdf:rest d:loop .")
    return lists.walk(u.select("s", "p", "o"))


# --- consistency -----------------------------------------------------------------------------------------------------


def inconsistent(name: str, tbox: str, abox: tuple | None, sql: str) -> None:
    def query(spark, sf_dir):
        u = graph(spark, tbox)
        u = u.union(quads(spark, sf_dir, *abox)) if abox else u
        return consistency.detect(u.select("s", "p", "o").distinct(), name).drop("rule")

    _register("inconsistent_" + name.replace("-", "_"), sql if sql.startswith("SELECT") else _values(sql))(query)


inconsistent("prp-irp", "r:p a owl:IrreflexiveProperty . d:a r:p d:a, d:b .", None, "d:a r:p d:a .")
inconsistent("prp-asyp", "r:inNation a owl:AsymmetricProperty . <urn:d:nation:6> r:inNation <urn:d:customer:1> .", _NATIONS, "SELECT '<urn:d:customer:1>' AS s, '<urn:r:inNation>' AS p, '<urn:d:nation:6>' AS o FROM customer WHERE c_custkey = 1 AND c_nationkey = 6")
inconsistent("prp-pdw", "r:a owl:propertyDisjointWith r:b . d:x r:a d:y ; r:b d:y, d:z .", None, "d:x r:a d:y .")
inconsistent("prp-adp", "d:all a owl:AllDisjointProperties ; owl:members ( r:b r:a r:c ) . d:x r:a d:y ; r:b d:y .", None, "d:x r:a d:y .")
inconsistent("prp-npa1", "d:n owl:sourceIndividual <urn:d:nation:6> ; owl:assertionProperty r:inRegion ; owl:targetIndividual <urn:d:region:3> .", (["nation"], ["<urn:r:inRegion>"]), "SELECT '<urn:d:nation:6>' AS s, '<urn:r:inRegion>' AS p, '<urn:d:region:3>' AS o FROM nation WHERE n_nationkey = 6 AND n_regionkey = 3")
inconsistent("prp-npa2", "d:n owl:sourceIndividual d:x ; owl:assertionProperty r:age ; owl:targetValue 42 . d:x r:age 42, 43 .", None, "d:x r:age 42 .")
inconsistent("cls-nothing2", "d:x a owl:Nothing .", _TYPES, "d:x a owl:Nothing .")
inconsistent("cls-com", "c:Customer owl:complementOf c:Robot . <urn:d:customer:1> a c:Robot .", _TYPES, f"SELECT '<urn:d:customer:1>' AS s, '{TYPE}' AS p, '<urn:c:Customer>' AS o")
inconsistent("cls-maxc1", 'c:Customer owl:maxCardinality "0"^^xsd:nonNegativeInteger ; owl:onProperty r:inNation .', (["customer"], [TYPE, "<urn:r:inNation>"]), _of_customers("<urn:r:inNation>", _N))
inconsistent("cls-maxqc1", 'c:Customer owl:maxQualifiedCardinality "0"^^xsd:nonNegativeInteger ; owl:onProperty r:inNation ; owl:onClass c:Far . <urn:d:nation:3> a c:Far .', (["customer"], [TYPE, "<urn:r:inNation>"]), _of_customers("<urn:r:inNation>", _N) + " WHERE c_nationkey = 3")
inconsistent("cls-maxqc2", 'c:Customer owl:maxQualifiedCardinality "0"^^xsd:nonNegativeInteger ; owl:onProperty r:inNation ; owl:onClass owl:Thing .', (["customer"], [TYPE, "<urn:r:inNation>"]), _of_customers("<urn:r:inNation>", _N))
inconsistent("cax-dw", "c:Customer owl:disjointWith c:Bird . <urn:d:customer:5> a c:Bird . <urn:d:x:1> a c:Bird .", _TYPES, f"SELECT '<urn:d:customer:5>' AS s, '{TYPE}' AS p, '<urn:c:Bird>' AS o")
inconsistent("cax-adc", "d:all a owl:AllDisjointClasses ; owl:distinctMembers ( c:Customer c:Bird c:Fish ) . <urn:d:customer:5> a c:Bird .", _TYPES, f"SELECT '<urn:d:customer:5>' AS s, '{TYPE}' AS p, '<urn:c:Bird>' AS o")
inconsistent("eq-diff1", "d:y owl:differentFrom d:x . d:x owl:sameAs d:y .", None, "d:x owl:sameAs d:y .")
inconsistent("eq-diff2", "d:all a owl:AllDifferent ; owl:members ( d:x d:y d:z ) . d:y owl:sameAs d:x .", None, "d:x owl:sameAs d:y .")
inconsistent("eq-diff3", "d:all a owl:AllDifferent ; owl:distinctMembers ( d:x d:y d:z ) . d:y owl:sameAs d:z .", None, "d:y owl:sameAs d:z .")
inconsistent("dt-not-type", 'd:a r:p "thirty"^^xsd:integer, "30"^^xsd:int, " 1"^^xsd:long, "-1"^^xsd:unsignedInt, "0"^^xsd:positiveInteger, "yes"^^xsd:boolean, "1"^^xsd:boolean, "9223372036854775808"^^xsd:integer, "18446744073709551615"^^xsd:unsignedLong .', (["part"], ["<urn:p:p_size>"]),
             'd:a r:p "thirty"^^xsd:integer, " 1"^^xsd:long, "-1"^^xsd:unsignedInt, "0"^^xsd:positiveInteger, "yes"^^xsd:boolean, "9223372036854775808"^^xsd:integer .')


@_register("consistent_all", f"SELECT 'cax-dw' AS rule, '<urn:d:customer:5>' AS s, '{TYPE}' AS p, '<urn:c:Bird>' AS o UNION ALL SELECT 'prp-irp', '<urn:d:a>', '<urn:r:p>', '<urn:d:a>'")
def consistent_all(spark, sf_dir):
    u = graph(spark, "c:Customer owl:disjointWith c:Bird . <urn:d:customer:5> a c:Bird . r:p a owl:IrreflexiveProperty . d:a r:p d:a .").union(quads(spark, sf_dir, *_TYPES))
    return consistency.violations(u.select("s", "p", "o").distinct())


# --- SHACL -----------------------------------------------------------------------------------------------------------


def shape(name: str, tables: str, text: str, sql: str) -> None:
    """Violations of one shape over tables: focus, value (as encoded terms) and message."""

    def query(spark, sf_dir):
        rows = parse_turtle(TURTLE + text)
        needed = [x for x in {t for r in rows for t in r} if x.startswith(("<urn:p:", "<urn:r:"))] + [TYPE]
        found = shacl.violations(quads(spark, sf_dir, tables.split(), needed), rows, None)
        return found.select(F.col("focusNode").alias("focus"), "value", F.col("resultMessage").alias("message"))

    _register("shacl_" + name, sql)(query)


def _focus(kind: str, key: str) -> str:
    return f"'<urn:d:{kind}:' || {key} || '>' AS focus"


_CUST = "d:S a sh:NodeShape ; sh:targetClass c:Customer ; sh:property [ "
_LIT = lambda c: f"'\"' || {c} || '\"'"
_DECIMAL = lambda c: f"'\"' || CAST({c} AS DECIMAL(18,2)) || '\"^^<{XSD}decimal>'"
shape("min_count_inverse", "customer orders", _CUST + "sh:path [ sh:inversePath r:placedBy ] ; sh:minCount 1 ] .", f"SELECT {_focus('customer', 'c_custkey')}, CAST(NULL AS VARCHAR) AS value, 'Less than 1 values on path (found 0)' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
shape("max_count", "customer orders", _CUST + "sh:path [ sh:inversePath r:placedBy ] ; sh:maxCount 15 ] .", f"SELECT {_focus('customer', 'o_custkey')}, CAST(NULL AS VARCHAR) AS value, 'More than 15 values on path (found ' || count(*) || ')' AS message FROM orders GROUP BY o_custkey HAVING count(*) > 15")
shape("datatype", "customer", _CUST + "sh:path p:c_acctbal ; sh:datatype xsd:integer ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_DECIMAL('c_acctbal')} AS value, 'Value does not have datatype <{XSD}integer>' AS message FROM customer")
shape("node_kind", "customer", _CUST + "sh:path p:c_name ; sh:nodeKind sh:IRI ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_LIT('c_name')} AS value, 'Value does not have nodeKind <{SH}IRI>' AS message FROM customer")
shape("class", "customer nation", _CUST + "sh:path r:inNation ; sh:class c:Region ] .", f"SELECT {_focus('customer', 'c_custkey')}, '<urn:d:nation:' || c_nationkey || '>' AS value, 'Value is not an instance of class <urn:c:Region>' AS message FROM customer")
shape("pattern", "customer", _CUST + "sh:path p:c_mktsegment ; sh:pattern '^[bm]' ; sh:flags 'i' ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_LIT('c_mktsegment')} AS value, 'Value does not match pattern \"^[bm]\"' AS message FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[bm]', 'i')")
shape("min_length", "customer", _CUST + "sh:path p:c_mktsegment ; sh:minLength 9 ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_LIT('c_mktsegment')} AS value, 'Value has length less than 9' AS message FROM customer WHERE length(c_mktsegment) < 9")
shape("max_length", "customer", _CUST + "sh:path p:c_mktsegment ; sh:maxLength 9 ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_LIT('c_mktsegment')} AS value, 'Value has length greater than 9' AS message FROM customer WHERE length(c_mktsegment) > 9")
shape("in", "customer", _CUST + "sh:path p:c_mktsegment ; sh:in ( 'BUILDING' 'MACHINERY' ) ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_LIT('c_mktsegment')} AS value, 'Value is not in the allowed sh:in list' AS message FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
shape("has_value", "customer", _CUST + "sh:path r:inNation ; sh:hasValue <urn:d:nation:3> ] .", f"SELECT {_focus('customer', 'c_custkey')}, CAST(NULL AS VARCHAR) AS value, 'None of the values match the required sh:hasValue' AS message FROM customer WHERE c_nationkey <> 3")
shape("min_inclusive", "customer", _CUST + "sh:path p:c_acctbal ; sh:minInclusive 0 ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_DECIMAL('c_acctbal')} AS value, 'Value is less than 0 or not comparable' AS message FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 0")
shape("max_inclusive", "customer", _CUST + "sh:path p:c_acctbal ; sh:maxInclusive 5000 ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_DECIMAL('c_acctbal')} AS value, 'Value is greater than 5000 or not comparable' AS message FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 5000")
shape("path_sequence", "customer nation region", _CUST + "sh:path ( r:inNation r:inRegion p:r_name ) ; sh:in ( 'EUROPE' 'ASIA' ) ] .", f"SELECT {_focus('customer', 'c_custkey')}, {_LIT('r_name')} AS value, 'Value is not in the allowed sh:in list' AS message FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('EUROPE', 'ASIA')")
shape("path_alternative", "nation", "d:S a sh:NodeShape ; sh:targetClass c:Nation ; sh:property [ sh:path [ sh:alternativePath ( p:n_name r:inRegion ) ] ; sh:maxCount 1 ] .", f"SELECT {_focus('nation', 'n_nationkey')}, CAST(NULL AS VARCHAR) AS value, 'More than 1 values on path (found 2)' AS message FROM nation")
shape("path_zero_or_more", "nation", "d:S sh:targetSubjectsOf r:inRegion ; sh:property [ sh:path [ sh:zeroOrMorePath r:inRegion ] ; sh:maxCount 1 ] .", f"SELECT {_focus('nation', 'n_nationkey')}, CAST(NULL AS VARCHAR) AS value, 'More than 1 values on path (found 2)' AS message FROM nation")
shape("path_one_or_more", "nation", "d:S sh:targetSubjectsOf r:inRegion ; sh:property [ sh:path [ sh:oneOrMorePath r:inRegion ] ; sh:in ( <urn:d:region:1> ) ] .", f"SELECT {_focus('nation', 'n_nationkey')}, '<urn:d:region:' || n_regionkey || '>' AS value, 'Value is not in the allowed sh:in list' AS message FROM nation WHERE n_regionkey <> 1")
shape("path_zero_or_one", "nation", "d:S sh:targetNode <urn:d:nation:4>, d:absent ; sh:property [ sh:path [ sh:zeroOrOnePath r:inRegion ] ; sh:minCount 2 ] .", "SELECT '<urn:d:absent>' AS focus, CAST(NULL AS VARCHAR) AS value, 'Less than 2 values on path (found 1)' AS message")
shape("target_objects_of", "nation", "d:S sh:targetObjectsOf r:inRegion ; sh:property [ sh:path p:r_name ; sh:minCount 1 ] .", "SELECT DISTINCT '<urn:d:region:' || n_regionkey || '>' AS focus, CAST(NULL AS VARCHAR) AS value, 'Less than 1 values on path (found 0)' AS message FROM nation")


@_register("shacl_report", f"SELECT '<{SH}conforms>' AS p, CAST(1 AS BIGINT) AS n UNION ALL SELECT '{TYPE}', 1 + count(*) FILTER (c_nationkey <> 3) FROM customer UNION ALL SELECT p, (SELECT count(*) FROM customer WHERE c_nationkey <> 3) FROM (VALUES ('<{SH}result>'), ('<{SH}focusNode>'), ('<{SH}resultPath>'), ('<{SH}sourceShape>'), ('<{SH}sourceConstraintComponent>'), ('<{SH}resultSeverity>'), ('<{SH}resultMessage>')) v(p)")
def shacl_report(spark, sf_dir):
    """Triples of the report graph by predicate."""
    rows = parse_turtle(TURTLE + _CUST + "sh:path r:inNation ; sh:hasValue <urn:d:nation:3> ] .")
    found = shacl.violations(quads(spark, sf_dir, ["customer"], [TYPE, "<urn:r:inNation>"]), rows, None)
    return shacl.report(found).groupBy("p").agg(F.count("*").alias("n"))


# --- delete and re-derive ----------------------------------------------------------------------------------------------


def overdelete(name: str, text: str, retract: str, sql: str) -> None:
    def query(spark, sf_dir):
        store = GraphStore(spark, graph(spark, text))
        store.rdf_owl_rl_materialise(None, "urn:g:i", {"track_dependencies": True})
        quad = spark.createDataFrame([(*r, None) for r in parse_turtle(TURTLE + retract)], "s string, p string, o string, g string").select(dred.key().alias("key"))
        gone = dred.cascade(store.deps, quad)
        cells = F.split("key", "\x01")
        return gone.select(cells[0].alias("s"), cells[2].alias("o"))

    _register("overdelete_" + name, sql)(query)


overdelete("direct", "c:A rdfs:subClassOf c:B . c:B rdfs:subClassOf c:C .", "c:B rdfs:subClassOf c:C .", "SELECT '<urn:c:A>' AS s, '<urn:c:C>' AS o")
overdelete("transitive", "c:A rdfs:subClassOf c:B . c:B rdfs:subClassOf c:C . c:C rdfs:subClassOf c:D .", "c:B rdfs:subClassOf c:C .", "SELECT * FROM (VALUES ('<urn:c:A>', '<urn:c:C>'), ('<urn:c:A>', '<urn:c:D>'), ('<urn:c:B>', '<urn:c:D>')) v(s, o)")
overdelete("multi", "c:A rdfs:subClassOf c:B1, c:B2 . c:B1 rdfs:subClassOf c:C . c:B2 rdfs:subClassOf c:C .", "c:B1 rdfs:subClassOf c:C .", "SELECT '' AS s, '' AS o WHERE false")
