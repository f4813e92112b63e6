"""OWL 2 RL materialisation: rounds of all rules over the triples as they stood when the round began.

After the first round a rule only joins the newest triples with all others: for each of its sources in turn, that source
is the newest triples. Sources that name a predicate which no new triple has are left out.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import PROV, TYPE, XSD, owl
from . import lists
from .durable import cut
from .owl_rules import CHAIN, REFLEXIVE, RULES, SATURATION, TRACKED, chains, needs


#: Predicates whose triples make up lists.
LISTED = {lists.FIRST, lists.REST, *lists.HEADS}


class ReasonerError(ValueError):
    pass


@dataclass
class Options:
    max_iterations: int = 50
    provenance: bool = False
    derived_by_iri: str = PROV + "wasDerivedFrom"
    derived_at_iri: str = PROV + "generatedAtTime"
    # a fixed value: consumers of annotations look for it
    rule_iri_prefix: str = "urn:semantica:rule:"
    equality_saturation: bool = True
    eq_reflexive: bool = False
    track_dependencies: bool = False


@dataclass
class Result:
    """new: (s, p, o) that the inferred graph gains, annotations included; derivations: rows of the dependency index;
    error: the text of a guard that stopped the rounds, after which `new` holds what they gave."""

    new: DataFrame
    derivations: DataFrame | None
    rounds: int
    error: str | None = None


def ask(spark: SparkSession, text: str, **frames: DataFrame | None) -> DataFrame:
    """SQL over frames that it names in braces; their views last only until the text is analysed."""
    views = {k: f"qd_{uuid.uuid4().hex}" for k, df in frames.items() if df is not None}
    for k, name in views.items():
        frames[k].createOrReplaceTempView(name)
    try:
        return spark.sql(text.format(**({k: "" for k in frames} | views)))
    finally:
        for name in views.values():
            spark.catalog.dropTempView(name)


def branches(text: str) -> list[str]:
    """The parts of a text that UNION ALL joins outside of parentheses."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"'[^']*'|[()]|\bUNION ALL\b", text):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif m[0] == "UNION ALL" and not depth:
            out.append(text[at : m.start()])
            at = m.end()
    return [*out, text[at:]]


def newest(text: str, predicates: set[str], classes: set[str]) -> str | None:
    """A rule's SQL with each of its sources {u} in turn as {d}, the newest triples, where those have the predicate (and
    class) that the source names. An aggregate needs all its rows, so such a rule stays as it is. None: nothing can be new."""
    if re.search(r"GROUP BY|HAVING", text):
        return text
    parts = []
    for branch in branches(text):
        pieces = branch.split("{u}")
        for i in range(1, len(pieces)):
            m = re.match(r" WHERE p = '(<[^']+>)'(?: AND o = '(<[^']+>)')?", pieces[i])
            if m and (m[1] not in predicates or (m[2] and m[2] not in classes)):
                continue
            parts.append("{u}".join(pieces[:i]) + "{d}" + "{u}".join(pieces[i:]))
    return " UNION ALL ".join(parts) or None


def constants() -> list[str]:
    return sorted({TYPE}.union(*[set(re.findall(r"\b(?:p|o) = '(<[^']+>)'", t)) for t in RULES.values()], LISTED))


def vocabulary(u: DataFrame, more: tuple[str, ...] = ()) -> set[str]:
    """Predicates and classes in use among those that rules name: at most as many as the rules have."""
    named = sorted({CHAIN}.union(*[needs(t) for t in (*RULES.values(), *more)]))
    used = u.where(F.col("p").isin(*named)).select(F.col("p").alias("x")).union(u.where((F.col("p") == TYPE) & F.col("o").isin(*named)).select("o"))
    return {r["x"] for r in used.distinct().collect()}


def rule(spark: SparkSession, name: str, u: DataFrame, l: DataFrame | None = None) -> DataFrame:
    """(s, p, o) that one rule derives from triples u, duplicates included; l: lists, walked here if not given."""
    text = RULES[name]
    if name == "prp-spo2" or "{l}" in text:
        l = lists.walk(u) if l is None else l  # noqa: E741
    if name == "prp-spo2":
        used = u.where(F.col("p") == owl("propertyChainAxiom")).select(F.col("o").alias("head")).distinct()
        lengths = sorted(r["n"] for r in l.join(used, "head").select("n").distinct().collect())
        text = chains(lengths)
    if not text:
        return spark.createDataFrame([], "s string, p string, o string")
    return ask(spark, text, u=u, l=l)


def materialise(asserted: DataFrame, inferred: DataFrame, options: Options | None = None, same_graph: bool = False) -> Result:
    """Close quads asserted(s, p, o, g) and inferred(s, p, o, g) under the rules.

    A triple that a round derives and the inferred graph lacks is new there, be it asserted elsewhere or not. The round
    that finds nothing counts. All rules of a round are one query: its result is cut, then counted. All triples, and those
    of the inferred graph, grow by parts.
    """
    spark = asserted.sparkSession
    options = options or Options()
    names = [n for n in RULES if (options.equality_saturation or n not in SATURATION) and (options.eq_reflexive or n not in REFLEXIVE)]
    base = cut((asserted if same_graph else asserted.unionByName(inferred)).select("s", "p", "o", "g").distinct())
    here = cut(inferred.select("s", "p", "o").distinct())
    gained = spark.createDataFrame([], "s string, p string, o string")
    u = cut(base.select("s", "p", "o").distinct())
    named = constants()
    delta = l = derivations = None
    there: set[str] = set()
    rounds = 0
    while True:
        rounds += 1
        if rounds > options.max_iterations:
            return Result(gained, derivations, rounds, f"fixpoint not reached after {options.max_iterations} iterations")
        predicates, classes, relisted = set(named), set(named), True
        if delta is not None:
            predicates = {r["p"] for r in delta.where(F.col("p").isin(*named)).select("p").distinct().collect()}  # at most as many as rules name
            classes = {r["o"] for r in delta.where((F.col("p") == TYPE) & F.col("o").isin(*named)).select("o").distinct().collect()}
            relisted = bool(predicates & LISTED)
        if relisted:
            l = lists.walk(u)  # noqa: E741
        there |= vocabulary(u if delta is None else delta)
        parts = None
        for n in names:
            if n == "prp-spo2" and CHAIN not in there or not needs(RULES[n]) <= there or (not RULES[n] and n != "prp-spo2"):
                continue  # what it reads isn't there
            if delta is None or n == "prp-spo2" or (relisted and "{l}" in RULES[n]):
                part = rule(spark, n, u, l)
            else:
                text = newest(RULES[n], predicates, classes)
                if text is None:
                    continue
                part = ask(spark, text, u=u, l=l, d=delta)
            part = part.select("s", "p", "o")
            if options.provenance:
                part = part.withColumn("rule", F.lit(n))
            parts = part if parts is None else parts.union(part)
        if options.track_dependencies:
            q = cut(base.unionByName(gained.withColumn("g", F.lit("\0inferred"))))
            for n, text in TRACKED.items():
                d = ask(spark, text, q=q).withColumn("rule", F.lit(n))
                derivations = d if derivations is None else derivations.union(d)
            derivations = cut(derivations.distinct())
        if parts is None:
            return Result(gained, derivations, rounds)
        new = cut(parts.distinct().join(here, ["s", "p", "o"], "left_anti"))
        if new.isEmpty():
            return Result(gained, derivations, rounds)
        fresh = new.select("s", "p", "o").distinct()
        if options.provenance:
            now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            quoted = F.concat(F.lit("<< "), "s", F.lit(" "), "p", F.lit(" "), "o", F.lit(" >>"))
            by = new.select(quoted.alias("s"), F.lit(f"<{options.derived_by_iri}>").alias("p"), F.concat(F.lit("<" + options.rule_iri_prefix), "rule", F.lit(">")).alias("o"))
            at = new.select(quoted.alias("s"), F.lit(f"<{options.derived_at_iri}>").alias("p"), F.lit(f'"{now}"^^<{XSD}dateTime>').alias("o"))
            fresh = fresh.union(by).union(at).distinct().join(here, ["s", "p", "o"], "left_anti")
        if options.provenance or "rule" in new.columns:
            fresh = cut(fresh)
        here, gained = here.union(fresh), gained.union(fresh)
        delta = cut(fresh.join(u, ["s", "p", "o"], "left_anti"))
        u = u.union(delta)
        if rounds % 8 == 0:  # so that plans don't grow with the rounds
            here, gained, u = cut(here), cut(gained), cut(u)
