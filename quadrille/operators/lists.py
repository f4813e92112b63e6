"""RDF lists of a graph, walked for all heads at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import owl, rdf
from .durable import cut

FIRST, REST, NIL = rdf("first"), rdf("rest"), rdf("nil")
HEADS = [owl(x) for x in ("intersectionOf", "unionOf", "oneOf", "propertyChainAxiom", "hasKey", "members", "distinctMembers")]


def walk(u: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(head, pos, item, n) of the well-formed lists among `heads` (head), by default all objects of list predicates.

    A list with a cell of no or several rdf:first or rdf:rest, with a literal or quoted rest, or with a cycle has no
    rows; rdf:nil as a head is an empty list and has none either. Distances to the end, then places, double in every round.
    """
    spark = u.sparkSession
    schema = "head string, pos int, item string, n int"
    cells = u.where(F.col("p").isin(FIRST, REST)).select("s", "p", "o").distinct()
    cells = cells.groupBy("s").agg(
        F.min(F.when(F.col("p") == FIRST, F.col("o"))).alias("item"), F.count(F.when(F.col("p") == FIRST, 1)).alias("firsts"),
        F.min(F.when(F.col("p") == REST, F.col("o"))).alias("rest"), F.count(F.when(F.col("p") == REST, 1)).alias("rests"),
    ).where("firsts = 1 AND rests = 1 AND NOT startswith(rest, '\"') AND NOT startswith(rest, '<<')").selectExpr("s AS cell", "item", "rest")
    cells = cut(cells)
    limit = cells.count()
    if not limit:
        return spark.createDataFrame([], schema)
    if heads is None:
        heads = u.where(F.col("p").isin(*HEADS)).selectExpr("o AS head").distinct()
    far, span = cells.selectExpr("cell", "rest AS dest", "1 AS dist"), 1
    while span < limit:
        ended, open_ = far.where(F.col("dest") == NIL), far.where(F.col("dest") != NIL)
        more = cut(open_.join(far.selectExpr("cell AS dest", "dest AS next", "dist AS more"), "dest").selectExpr("cell", "next AS dest", "dist + more AS dist"))
        if more.isEmpty():
            break
        far, span = cut(ended.union(more)), span * 2
    ended = cut(far.where(F.col("dest") == NIL).selectExpr("cell", "dist AS n"))
    at = cut(heads.join(ended.withColumnRenamed("cell", "head"), "head").selectExpr("head", "n", "0 AS pos", "head AS cell"))
    longest = at.agg(F.max("n")).first()[0]
    if not longest:
        return spark.createDataFrame([], schema)
    jump, span = cells.join(ended, "cell", "left_semi").where(F.col("rest") != NIL).selectExpr("cell", "rest AS dest"), 1
    while span < longest:  # the first `span` places of every list are known; a jump doubles them
        at = cut(at.union(at.join(jump, "cell").selectExpr("head", "n", f"pos + {span} AS pos", "dest AS cell")))
        span *= 2
        if span < longest:
            jump = cut(jump.join(jump.selectExpr("cell AS dest", "dest AS next"), "dest").selectExpr("cell", "next AS dest"))
    return cut(at.join(cells, "cell").select("head", "pos", "item", "n"))
