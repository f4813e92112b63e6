"""Delete and re-derive: the dependency index and its cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut

QUAD = ("s", "p", "o", "g")


def key(prefix: str = "", suffix: str = ""):
    """One string for a quad; graphs and the default graph stay apart."""
    return F.concat_ws("\x01", *[F.col(f"{prefix}{c}{suffix}") for c in "spo"], F.coalesce(F.col(f"{prefix}g{suffix}"), F.lit("\0")))


def index(derivations: DataFrame) -> DataFrame:
    """(inferred, derivation, premise) of rows (s, p, o, g, s1..g1, s2..g2): quads as keys, premise sets once each."""
    rows = derivations.select(key().alias("inferred"), F.array_sort(F.array_distinct(F.array(key(suffix="1"), key(suffix="2")))).alias("premises")).distinct()
    return rows.select("inferred", F.xxhash64("inferred", "premises").alias("derivation"), F.explode("premises").alias("premise"))


def cascade(deps: DataFrame, retracted: DataFrame) -> DataFrame:
    """(key) of the inferred quads all of whose derivations hold a removed premise, transitively.

    retracted: (key). A least fixpoint: quads that support each other in a cycle stay. Retracted quads aren't returned
    unless they lose all their own derivations.
    """
    total = cut(deps.groupBy("inferred").agg(F.count_distinct("derivation").alias("n")))
    removed = cut(retracted.select("key").distinct())
    dead = None
    frontier = removed
    broken = None
    while True:
        hit = deps.join(frontier.withColumnRenamed("key", "premise"), "premise", "left_semi").select("inferred", "derivation").distinct()
        broken = cut(hit if broken is None else broken.union(hit).distinct())
        lost = broken.groupBy("inferred").agg(F.count("*").alias("b")).join(total, "inferred").where("b = n").select(F.col("inferred").alias("key"))
        new = cut(lost if dead is None else lost.join(dead, "key", "left_anti"))
        if new.isEmpty():
            return dead if dead is not None else new
        dead = new if dead is None else cut(dead.union(new))
        frontier = new


def forget(deps: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the derivations of quads gone(key)."""
    return deps.join(gone.withColumnRenamed("key", "inferred"), "inferred", "left_anti")
