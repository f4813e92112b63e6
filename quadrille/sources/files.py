"""Files of triples, read by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import to_ntriples
from .rdfxml import parse_rdfxml
from .turtle import parse_ntriples, parse_turtle

QUADS = "s string, p string, o string, g string"


def read_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """(s, p, o, g) of N-Triples files: every line is on its own, so files are split and parsed in parallel.

    Labels of blank nodes are scoped by file. graph: encoded name, NULL for the default graph.
    """
    lines = spark.read.text(path).select("value", F.substring(F.md5(F.input_file_name()), 1, 12).alias("file"))
    lines = lines.where("trim(value) <> '' AND NOT startswith(trim(value), '#')")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, own in b.groupby("file"):
                yield pd.DataFrame([(*r, graph) for r in parse_ntriples("\n".join(own["value"]), "f" + file)], columns=["s", "p", "o", "g"])

    return lines.mapInPandas(run, QUADS)


def read_documents(spark: SparkSession, path: str, form: str = "turtle", graph: str | None = None) -> DataFrame:
    """(s, p, o, g) of Turtle or RDF/XML files, one file a task at least: such documents can't be split."""
    parse = {"turtle": parse_turtle, "rdfxml": parse_rdfxml}[form]
    files = spark.read.text(path, wholetext=True).select("value", F.substring(F.md5(F.input_file_name()), 1, 12).alias("file"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, file in zip(b["value"], b["file"]):
                yield pd.DataFrame([(*r, graph) for r in parse(text, "f" + file)], columns=["s", "p", "o", "g"])

    return files.mapInPandas(run, QUADS)


def write_ntriples(quads: DataFrame, path: str) -> None:
    """Lines of N-Triples, one file a partition; graph names are dropped."""
    quads.select(F.concat_ws(" ", *[to_ntriples(F.col(c)) for c in "spo"], F.lit(".")).alias("value")).write.text(path)
