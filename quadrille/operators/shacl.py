"""SHACL Core validation: per property shape one set-oriented plan, all shapes in one union.

Shapes, a small graph, are read on the driver; focus nodes, path values and violations stay distributed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import _double
from ..functions.vocab import PROV, RDF, SH, TYPE, XSD, rdfs, sh
from . import closure
from .durable import cut

COLUMNS = "focusNode string, resultPath string, value string, sourceShape string, sourceConstraintComponent string, resultSeverity string, resultMessage string"
TARGETS = ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf")
FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)$"


class ShaclError(ValueError):
    pass


@dataclass
class Options:
    max_violations: int | None = 10_000  # more are an error; None: no limit
    provenance: bool = False
    # fixed values: consumers of reports look for these IRIs
    reported_by_iri: str = "urn:semantica:shacl:reportedBy"
    reported_at_iri: str = PROV + "generatedAtTime"
    shape_iri_prefix: str = "urn:semantica:shape:"


@dataclass
class PropertyShape:
    node: str
    path: str
    given: dict = field(default_factory=dict)


class Shapes:
    """A shapes graph: subject -> predicate -> objects."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.of: dict = defaultdict(lambda: defaultdict(list))
        for s, p, o in sorted(set(rows)):
            self.of[s][p].append(o)

    def one(self, s: str, p: str) -> str | None:
        return next(iter(self.of[s][p]), None) if s in self.of else None

    def nodes(self) -> list[str]:
        return [s for s, by in list(self.of.items()) if any(by.get(sh(t)) for t in TARGETS) or sh("NodeShape") in by.get(TYPE, [])]

    def list_of(self, head: str) -> list[str]:
        items, seen = [], set()
        while head != f"<{RDF}nil>":
            first, rest = self.one(head, f"<{RDF}first>"), self.one(head, f"<{RDF}rest>")
            if head in seen or first is None or rest is None:
                raise ShaclError("rdf_shacl_core_validate: malformed RDF list")
            seen.add(head)
            items.append(first)
            head = rest
        return items

    def properties(self, shape: str) -> list[PropertyShape]:
        out = []
        for node in self.of[shape].get(sh("property"), []):
            path = self.one(node, sh("path"))
            if path is None:
                raise ShaclError("rdf_shacl_core_validate: a property shape has no sh:path")
            given = {p[len(SH) + 1 : -1]: o[0] for p, o in self.of[node].items() if p.startswith(f"<{SH}") and o}
            out.append(PropertyShape(node, path, given))
        return out

    def path(self, node: str):
        """Path tree: (kind, parts)."""
        if node.startswith('"'):
            raise ShaclError("rdf_shacl_core_validate: a literal can't be a path")
        if node.startswith("<") and not node.startswith("<<"):
            return ("link", node)
        for kind in ("inversePath", "alternativePath", "zeroOrMorePath", "oneOrMorePath", "zeroOrOnePath"):
            arg = self.one(node, sh(kind))
            if arg is not None:
                return (kind, [self.path(x) for x in self.list_of(arg)]) if kind == "alternativePath" else (kind, self.path(arg))
        return ("sequence", [self.path(x) for x in self.list_of(node)])


def path_steps(data: DataFrame, path) -> DataFrame | None:
    """(s, o) pairs of a path without closures; None where its focus must be known first."""
    kind, arg = path
    if kind == "link":
        return data.where(F.col("p") == arg).select("s", "o")
    if kind == "inversePath":
        if arg[0] == "link":
            return data.where((F.col("p") == arg[1]) & ~F.startswith("o", F.lit('"'))).selectExpr("o AS s", "s AS o")
        if arg[0] == "inversePath":
            return path_steps(data, arg[1])
        return data.where(F.lit(False)).select("s", "o")  # no inverse of a compound path
    return None


def path_values(data: DataFrame, focus: DataFrame, path) -> DataFrame:
    """Distinct (f, v): the values that a path leads to from each focus (f, at) at its node `at`."""
    kind, arg = path
    hop = lambda a, e: a.join(e.select(e["s"].alias("at"), e["o"].alias("_v")), "at").selectExpr("f", "_v AS v").distinct()
    res = lambda df: df.where(~F.startswith("v", F.lit('"'))).selectExpr("f", "v AS at")
    steps = path_steps(data, path)
    if steps is not None:
        return hop(focus, steps)
    if kind == "sequence":
        now = focus
        for i, step in enumerate(arg):
            now = path_values(data, now if i == 0 else res(now), step)
        return now
    if kind == "alternativePath":
        return reduce(DataFrame.union, [path_values(data, focus, x) for x in arg]).distinct()
    own = focus.selectExpr("f", "at AS v")
    if kind == "zeroOrOnePath":
        return own.union(path_values(data, focus, arg)).distinct()
    first = path_values(data, focus, arg)
    seen, frontier = cut(first), cut(res(first))
    while True:  # only what is new moves on; literals end
        step = path_values(data, frontier, arg).where(~F.startswith("v", F.lit('"')))
        new = cut(step.join(seen, ["f", "v"], "left_anti"))
        if new.isEmpty():
            break
        seen = cut(seen.union(new))
        frontier = new.selectExpr("f", "v AS at")
    if kind == "oneOrMorePath":
        return seen
    return own.union(seen.where(~F.startswith("v", F.lit('"')))).distinct()


def targets(data: DataFrame, shapes: Shapes, shape: str) -> DataFrame:
    spark, by = data.sparkSession, shapes.of[shape]
    parts = []
    nodes = [t for t in by.get(sh("targetNode"), []) if not t.startswith('"')]
    if nodes:
        parts.append(spark.createDataFrame([(n,) for n in nodes], "f string"))
    for c in by.get(sh("targetClass"), []):
        parts.append(data.where((F.col("p") == TYPE) & (F.col("o") == c)).selectExpr("s AS f"))
    for p in by.get(sh("targetSubjectsOf"), []):
        parts.append(data.where(F.col("p") == p).selectExpr("s AS f"))
    for p in by.get(sh("targetObjectsOf"), []):
        parts.append(data.where((F.col("p") == p) & ~F.startswith("o", F.lit('"'))).selectExpr("o AS f"))
    return reduce(DataFrame.union, parts).distinct() if parts else spark.createDataFrame([], "f string")


def _number(text: str | None, name: str) -> int:
    m = re.match(r'^"\+?([0-9]+)"', text or "")
    if not m:
        raise ShaclError(f"rdf_shacl_core_validate: sh:{name} is not a non-negative integer")
    return int(m[1])


def _as_double(c: Column) -> Column:
    lex = T.lexical(c)
    return F.when(lex.rlike("(?i)" + FLOAT), F.coalesce(_double(lex), F.when(F.lower(lex).rlike("^[+]?inf"), F.lit(float("inf"))).when(F.lower(lex).rlike("^-inf"), F.lit(float("-inf")))))


def instances(data: DataFrame, cls: str) -> DataFrame:
    """(v): nodes of the class or of one below it in the data."""
    below = closure.reachable(data.sparkSession.createDataFrame([(cls,)], "n string"), data.where((F.col("p") == rdfs("subClassOf")) & T.is_iri(F.col("o")) & T.is_iri(F.col("s"))).selectExpr("o AS s", "s AS o"))
    classes = below.union(data.sparkSession.createDataFrame([(cls,)], "n string")).distinct()
    return data.where(F.col("p") == TYPE).join(classes.withColumnRenamed("n", "o"), "o", "left_semi").selectExpr("s AS v").distinct()


def check(data: DataFrame, focus: DataFrame, values: DataFrame, ps: PropertyShape, shapes: Shapes) -> list[DataFrame]:
    """Violations of every constraint of a property shape, in the fixed order of components.

    Messages are fixed values: consumers of reports compare them.
    """
    g, out = ps.given, []

    def add(rows: DataFrame, component: str, message, value: bool = True) -> None:
        out.append(rows.select(
            F.col("f").alias("focusNode"), F.lit(ps.path).alias("resultPath"), (F.col("v") if value else F.lit(None).cast("string")).alias("value"), F.lit(ps.node).alias("sourceShape"),
            F.lit(sh(component + "ConstraintComponent")).alias("sourceConstraintComponent"), F.lit(sh("Violation")).alias("resultSeverity"), (message if isinstance(message, Column) else F.lit(message)).alias("resultMessage"),
        ))

    def counted() -> DataFrame:
        return focus.select("f").join(values.groupBy("f").agg(F.count("*").alias("n")), "f", "left").select("f", F.coalesce("n", F.lit(0)).alias("n"))

    v = F.col("v")
    if "minCount" in g:
        n = _number(g["minCount"], "minCount")
        add(counted().where(F.col("n") < n), "MinCount", F.concat(F.lit(f"Less than {n} values on path (found "), F.col("n").cast("string"), F.lit(")")), False)
    if "maxCount" in g:
        n = _number(g["maxCount"], "maxCount")
        add(counted().where(F.col("n") > n), "MaxCount", F.concat(F.lit(f"More than {n} values on path (found "), F.col("n").cast("string"), F.lit(")")), False)
    if "datatype" in g:
        dt = g["datatype"].strip("<>")
        add(values.where(~F.coalesce(T.datatype_of(v) == dt, F.lit(False))), "Datatype", f"Value does not have datatype <{dt}>")
    if "nodeKind" in g:
        kind = g["nodeKind"].strip("<>").removeprefix(SH)
        tests = {"IRI": T.is_iri, "BlankNode": T.is_blank, "Literal": T.is_literal}
        if not all(k in tests for k in kind.split("Or")):
            raise ShaclError(f"rdf_shacl_core_validate: unknown sh:nodeKind {g['nodeKind']}")
        good = reduce(lambda a, b: a | b, [tests[k](v) for k in kind.split("Or")])
        add(values.where(~good), "NodeKind", f"Value does not have nodeKind <{SH}{kind}>")
    if "class" in g:
        add(values.join(instances(data, g["class"]), "v", "left_anti"), "Class", f"Value is not an instance of class {g['class']}")
    if "pattern" in g:
        pattern, flags = (x and re.sub(r'(?s)^"(.*)".*$', r"\1", x) for x in (g["pattern"], g.get("flags")))
        text = T.text_of(v)
        expr = f"(?{flags}){pattern}" if flags else pattern
        bad = values.where(text.isNull() | ~text.rlike(expr))
        add(bad, "Pattern", F.when(text.isNull(), "Value cannot be tested against sh:pattern (not a literal or IRI)").otherwise(f'Value does not match pattern "{pattern}"'))
    for name, word in (("minLength", "less"), ("maxLength", "greater")):
        if name in g:
            n = _number(g[name], name)
            text = T.text_of(v)
            wrong = F.length(text) < n if name == "minLength" else F.length(text) > n
            add(values.where(text.isNull() | wrong), name[0].upper() + name[1:], F.when(text.isNull(), f"Value cannot be tested against sh:{name} (not a literal or IRI)").otherwise(f"Value has length {word} than {n}"))
    if "in" in g:
        allowed = shapes.list_of(g["in"])
        add(values.where(~v.isin(*allowed)) if allowed else values, "In", "Value is not in the allowed sh:in list")
    if "hasValue" in g:
        have = values.where(v == g["hasValue"]).select("f").distinct()
        add(focus.select("f").join(have, "f", "left_anti"), "HasValue", "None of the values match the required sh:hasValue", False)
    for name, word in (("minInclusive", "less"), ("maxInclusive", "greater")):
        if name in g:
            lex = re.sub(r'(?s)^"(.*)".*$', r"\1", g[name])
            if not g[name].startswith('"') or not re.match("(?i)" + FLOAT, lex):
                raise ShaclError(f"rdf_shacl_core_validate: sh:{name} bound is not a numeric literal")
            bound, d = float(lex), _as_double(v)
            good = (d >= bound if name == "minInclusive" else d <= bound) & ~F.isnan(d) & F.lit(bound == bound)
            add(values.where(~F.coalesce(good, F.lit(False))), name[0].upper() + name[1:], f"Value is {word} than {lex} or not comparable")
    return out


def violations(data: DataFrame, shapes_rows: list[tuple[str, str, str]], max_violations: int | None = 10_000) -> DataFrame:
    """Violations (COLUMNS) of data(s, p, o) against a shapes graph; more than max_violations is an error."""
    shapes = Shapes(shapes_rows)
    data = data.select("s", "p", "o").distinct()
    parts = []
    for shape in shapes.nodes():
        focus = targets(data, shapes, shape)
        for ps in shapes.properties(shape):
            path = shapes.path(ps.path)
            values = path_values(data, focus.selectExpr("f", "f AS at"), path)
            parts += check(data, focus, values, ps, shapes)
    found = reduce(DataFrame.union, parts) if parts else data.sparkSession.createDataFrame([], COLUMNS)
    if max_violations is not None:
        found = cut(found)
        if found.limit(max_violations + 1).count() > max_violations:
            raise ShaclError(f"rdf_shacl_core_validate: violations exceeded max_violations ({max_violations})")
    return found


def report(found: DataFrame, options: Options | None = None) -> DataFrame:
    """(s, p, o) of the validation report of violations. Nodes of results are blank and named by their content."""
    options = options or Options()
    spark = found.sparkSession
    now = f'"{datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}"^^<{XSD}dateTime>'
    conforms = "true" if found.isEmpty() else "false"
    head = spark.createDataFrame([("_:report", TYPE, sh("ValidationReport")), ("_:report", sh("conforms"), f'"{conforms}"^^<{XSD}boolean>')], "s string, p string, o string")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    node = F.concat(F.lit("_:r"), F.md5(F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in names])))
    shape = F.when(T.is_iri(F.col("sourceShape")), F.col("sourceShape")).otherwise(F.concat(F.lit("<" + options.shape_iri_prefix), F.regexp_replace("sourceShape", "^_:", ""), F.lit(">")))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    rows = [triple(F.lit("_:report"), sh("result"), node), triple(node, TYPE, F.lit(sh("ValidationResult")))]
    for c in names:
        value = {"sourceShape": shape, "resultMessage": F.concat(F.lit('"'), "resultMessage", F.lit('"'))}.get(c, F.col(c))
        rows.append(triple(node, sh(c), value))
    if options.provenance:
        rows += [triple(node, f"<{options.reported_by_iri}>", shape), triple(node, f"<{options.reported_at_iri}>", F.lit(now))]
    return head.union(found.select(F.explode(F.array(*rows)).alias("t")).select("t.*").where("o IS NOT NULL"))
