"""Relational tables as quads, kept by predicate so that a pattern reads only the columns that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import TYPE, XSD
from ..plans.compiler import Mapped, MappedTables, RowMap

#: table: (class, key columns; None hashes the row, subject kind)
CLASSES = {
    "region": ("Region", ["r_regionkey"], "region"), "nation": ("Nation", ["n_nationkey"], "nation"), "customer": ("Customer", ["c_custkey"], "customer"),
    "supplier": ("Supplier", ["s_suppkey"], "supplier"), "part": ("Part", ["p_partkey"], "part"), "orders": ("Order", ["o_orderkey"], "order"),
    "lineitem": ("LineItem", None, "lineitem"), "events": ("Event", ["event_id"], "event"), "documents": ("Document", ["doc_id"], "document"),
    "labels": ("Label", ["doc_id"], "label"), "pages": ("Page", ["page_id"], "page"), "conversations": ("Turn", ["conv_id", "turn"], "turn"),
}
#: table: {column: (predicate, subject kind of what it points to)}
LINKS = {
    "nation": {"n_regionkey": ("inRegion", "region")}, "customer": {"c_nationkey": ("inNation", "nation")}, "supplier": {"s_nationkey": ("inNation", "nation")},
    "orders": {"o_custkey": ("placedBy", "customer")}, "lineitem": {"l_orderkey": ("ofOrder", "order"), "l_partkey": ("ofPart", "part"), "l_suppkey": ("bySupplier", "supplier")},
    "events": {"user_id": ("byUser", "user")},
}


def node(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"<urn:d:{kind}:"), c.cast("string"), F.lit(">"))


def literal(c: Column, dtype: str) -> Column:
    """Encoded literal of a column; amounts get two decimals, times are written to the second."""
    if dtype in ("int", "bigint", "smallint"):
        return F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{XSD}integer>'))
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        return F.concat(F.lit('"'), c.cast("decimal(18,2)").cast("string"), F.lit(f'"^^<{XSD}decimal>'))
    if dtype.startswith("timestamp"):
        return F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f'"^^<{XSD}dateTime>'))
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def row_map(df: DataFrame, table: str) -> RowMap:
    """One table's rows as subjects. Its keys are primary keys; where it has none, rows that are alike are one subject."""
    cls, keys, kind = CLASSES[table]
    links, types = LINKS.get(table, {}), dict(df.dtypes)
    if keys is None:
        own = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
        df = df.distinct()
        subject = Mapped(node(kind, F.sha2(F.concat_ws("|", *own), 256)), "iri")
    else:
        plain = keys[0] if len(keys) == 1 and types[keys[0]] in ("int", "bigint") else None
        subject = Mapped(node(kind, F.concat_ws(":", *keys)), "iri", plain, f"<urn:d:{kind}:")
    objects = {TYPE: Mapped(F.lit(f"<urn:c:{cls}>"), "iri")}
    required = {}
    for c, dtype in types.items():
        if c in links:
            p, to = links[c]
            objects[f"<urn:r:{p}>"] = Mapped(node(to, F.col(c)), "iri", c if dtype in ("int", "bigint") else None, f"<urn:d:{to}:")
            required[f"<urn:r:{p}>"] = c
        elif c not in (keys or []):
            known = "integer" if dtype in ("int", "bigint", "smallint") else "decimal" if dtype in ("double", "float") or dtype.startswith("decimal") else "dateTime" if dtype.startswith("timestamp") else "string"
            objects[f"<urn:p:{c}>"] = Mapped(literal(F.col(c), dtype), known, c if dtype == "string" else None)
            required[f"<urn:p:{c}>"] = c
    return RowMap(df, subject, objects, required)


def dataset(spark: SparkSession, sf_dir: str, tables: list[str]) -> MappedTables:
    return MappedTables(spark, [row_map(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t) for t in tables])


def quads(spark: SparkSession, sf_dir: str, tables: list[str], predicates: list[str] | None = None) -> DataFrame:
    """(s, p, o, g) of the tables, of some predicates only if given: one scan a table."""
    source = dataset(spark, sf_dir, tables)
    if predicates is not None:
        source.maps = [RowMap(m.df, m.subject, own, m.required) for m in source.maps if (own := {p: o for p, o in m.objects.items() if p in predicates})]
    return source.scan()
