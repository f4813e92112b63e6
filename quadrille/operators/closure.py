"""Closures over edges (s, o), optionally within groups, by semi-naive doubling or by growing a frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .durable import cut, drop


def transitive(edges: DataFrame, within: list[str] = ()) -> DataFrame:
    """Pairs joined by one edge or more. Each round joins the newest pairs with all pairs on both sides, so the number of
    rounds is about log2 of the longest shortest path."""
    keys = [*within, "s", "o"]

    def hop(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(*within, y["s"].alias("_mid"), y["o"].alias("_far")).withColumnRenamed("_mid", "o")
        return x.join(y, [*within, "o"]).select(*within, "s", "_far").withColumnRenamed("_far", "o")

    pairs = cut(edges.select(*keys).distinct())
    new = pairs
    while True:
        found = hop(new, pairs).union(hop(pairs, new)).distinct()
        before, new = new, cut(found.join(pairs, keys, "left_anti").select(*keys))
        if before is not pairs:
            drop(before)
        if new.isEmpty():
            return pairs
        before, pairs = pairs, cut(pairs.union(new))
        drop(before)


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (n) that seeds (n) reach by one edge or more: only the frontier moves."""
    frontier = seeds.select("n").distinct()
    seen = None
    while True:
        step = frontier.join(edges.select(edges["s"].alias("n"), edges["o"].alias("_o")), "n").selectExpr("_o AS n").distinct()
        if seen is not None:
            step = step.join(seen, "n", "left_anti")
        frontier = cut(step)
        if frontier.isEmpty():
            return seen if seen is not None else frontier
        before, seen = seen, frontier if seen is None else cut(seen.union(frontier))
        drop(before)
