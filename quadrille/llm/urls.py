"""URL filter: path rules first, then naive Bayes on segmented names.

A host's labels are split at dots and hyphens and, where several words are run together, by a unigram Viterbi
segmentation. A label that shorter labels cover is no word of the dictionary, however often it is seen. A multinomial
naive Bayes over the words of host and path gives the verdict where no rule fits; it learns from the pages that a rule
decides, or from labels that are given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (action, host suffix, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Letters of the shortest part of a run-together name, and of the longest word.
PART, LONGEST = 3, 24

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN = re.compile(r"[^\W_]+")


def runs_of(host: str, path: str) -> list[str]:
    """Runs of letters and digits of a page, marked h: or p: by where they stand."""
    return ["h:" + r for r in _TOKEN.findall(host.lower())] + ["p:" + r for r in _TOKEN.findall(path.lower())]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ://, A-Z lower-cased; the path from its end to ?, # or the end. Both are
    empty for null or where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _A_TO_Z, _A_TO_Z.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; of equally long ones the first by name. Null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, action = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


class Segmenter:
    """Best split of a run of letters into words by the sum of their log-probabilities (Viterbi)."""

    def __init__(self, counts: dict[str, int], longest: int = LONGEST, total: int | None = None):
        """total: of the whole dictionary, where counts are only the part of it that a name holds."""
        total = total or sum(counts.values()) + len(counts) + 1
        self.score = {w: math.log((n + 1) / total) for w, n in counts.items() if 1 < len(w) <= longest}
        self.longest = max(map(len, self.score), default=1)
        self.unknown = math.log(1 / total)  # and a price per character, so that one long unknown word beats many

    def split(self, name: str) -> list[str]:
        n = len(name)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                s = self.score.get(name[start:end])
                if s is not None and best[start] + s > best[end]:
                    best[end], back[end] = best[start] + s, start
            for start in range(max(0, end - 64), end):  # an unknown word; longer ones are met piecewise
                s = best[start] + self.unknown - 2.5 * (end - start)
                if s > best[end]:
                    best[end], back[end] = s, start
        words, end = [], n
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def covered(word: str, parts: set[str]) -> bool:
    """Whether two or more of parts, in a row, are the word."""
    ends = {0}
    for end in range(PART, len(word) + 1):
        if any(word[start:end] in parts for start in ends if start or end < len(word)):
            ends.add(end)
    return len(word) in ends


def label_words(hosts: DataFrame, words=()) -> DataFrame:
    """(w, n): labels of distinct hosts(host) that are words of their own, and the hosts that show each.

    A label of which two or more other labels or `words` of at least PART letters are the parts is left out: it is a
    run-together name, and its parts are the words. Every label is compared with all others by a join.
    """
    spark = hosts.sparkSession
    labels = hosts.select(F.explode(F.split(F.lower("host"), "[^\\p{L}]+")).alias("w")).where("length(w) > 1").groupBy("w").agg(F.count("*").alias("n"))
    labels = common.materialise(labels, "url-labels")
    n = F.length("w")
    inner = F.expr(f"flatten(transform(sequence(1, length(w) - {PART - 1}), i -> transform(sequence({PART}, least(length(w) - i + 1, length(w) - 1, {LONGEST})), k -> substring(w, i, k))))")
    inside = labels.where(n.between(2 * PART, LONGEST) & ~F.col("w").isin(*words)).select("w", F.explode(inner).alias("part"))
    known = labels.select("w").union(spark.createDataFrame([(w,) for w in words], "w string")).where(n >= PART).distinct().select(F.col("w").alias("part"))
    found = inside.join(known, "part").groupBy("w").agg(F.collect_set("part").alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"w": [w for w, parts in zip(b["w"], b["parts"]) if covered(w, set(parts))]}, dtype=object)

    return labels.join(found.mapInPandas(run, "w string"), "w", "left_anti")


def split_runs(runs: DataFrame, hosts: DataFrame, words=()) -> DataFrame:
    """(run, words) of distinct runs(run): the dictionary, the hosts' labels and given `words`, stays a table, and a run meets
    the words it holds by a join."""
    spark = runs.sparkSession
    known = common.materialise(label_words(hosts, words), "url-dictionary")
    given = max(50, (known.agg(F.sum("n")).first()[0] or 0) // 200)
    known = known.where(~F.col("w").isin(*words)).union(spark.createDataFrame([(w, given) for w in words], "w string, n long"))
    total = known.agg(F.sum("n") + F.count("*") + 1).first()[0]
    inner = F.expr(f"flatten(transform(sequence(1, length(run) - 1), i -> transform(sequence(2, least(length(run) - i + 1, {LONGEST})), k -> substring(run, i, k))))")
    inside = runs.where(F.col("run").rlike("^\\p{L}{2,}$")).select("run", F.explode(inner).alias("w"))
    found = inside.join(known, "w").groupBy("run").agg(F.collect_set(F.struct("w", "n")).alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [Segmenter({h["w"]: h["n"] for h in held} if held is not None else {}, total=total).split(r) if r.isalpha() else [r] for r, held in zip(b["run"], b["held"])]
            yield pd.DataFrame({"run": b["run"], "words": parts})

    return runs.join(found, "run", "left").mapInPandas(run, "run string, words array<string>")


def train(rows: DataFrame, words=(), stop=()) -> tuple[DataFrame, float]:
    """(t, n, score) of every run of rows(host, path, bad), and the log-odds of a page without any: multinomial naive Bayes.

    `bad` is null for pages without a label; they teach nothing but the dictionary, whose word counts come from the labels
    of all hosts, run-together ones left out. Words in `stop` carry no weight. Words, their counts by label and the
    weights that follow are tables without a bound; only totals are collected. n: how often pages show a run.
    """
    of = [F.count("*").alias("n"), F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")]
    hosts = common.materialise(rows.where("host <> ''").groupBy("host").agg(*of), "url-hosts")
    paths = rows.where("path <> ''").groupBy("path").agg(*of)

    def runs(side: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [(t, n, x, g) for name, n, x, g in zip(b[side], b["n"], b["b"], b["g"]) for t in (runs_of(name, "") if side == "host" else runs_of("", name))]
                yield pd.DataFrame(found, columns=["t", "n", "b", "g"])

        return run

    kind = "t string, n long, b long, g long"
    shown = hosts.mapInPandas(runs("host"), kind).union(paths.mapInPandas(runs("path"), kind))
    shown = common.materialise(shown.groupBy("t").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("g").alias("g")), "url-runs").withColumn("run", F.substring("t", F.lit(3), F.length("t")))
    split = common.materialise(split_runs(shown.select("run").distinct(), hosts, words), "url-words")
    tokens = shown.join(split, "run").select("t", "n", "b", "g", F.explode("words").alias("w"))
    tokens = tokens.where(F.startswith("t", F.lit("h:")) | ~F.col("w").rlike("^\\p{Nd}+$")).withColumn("w", F.concat(F.left("t", F.lit(2)), "w"))
    tokens = common.materialise(tokens.where(~F.col("w").isin(*stop)) if stop else tokens, "url-tokens")
    counts = common.materialise(tokens.groupBy("w").agg(F.sum("b").alias("b"), F.sum("g").alias("g")), "url-counts")
    all_bad, all_good, size = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0)), F.count("*") + 1).first()
    weights = counts.select("w", (F.log((F.col("b") + 1) / F.lit(all_bad + size)) - F.log((F.col("g") + 1) / F.lit(all_good + size))).alias("weight"))
    scores = tokens.join(weights, "w").groupBy("t").agg(F.first("n").alias("n"), F.sum("weight").alias("score"))
    bad, good = rows.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    return common.materialise(scores, "url-scores"), math.log((bad + 1) / (good + 1))


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, words=(), head: int = 50_000) -> DataFrame:
    """pages(page_id, url): page_id, host, path, rule, verdict, score.

    A null url, or one without ://, has an empty host and path, and counts for nothing. The score is the log-odds of
    block; it decides where no rule fits. It is learned from labels(page_id, block boolean, one row a page) where they are
    given, else from the pages that a rule decides, in which the rules' own words carry no weight. `words` are added to the
    dictionary. Repeated rows are judged alike. The scores of the `head` most frequent runs go to the workers; pages with
    others get those by a join, which frequent runs then don't burden.
    """
    common.ship(pages.sparkSession)
    host, path = split_url(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    if labels is None:
        rows, stop = rows.withColumn("bad", action == "block"), sorted({t for _, name, start in rules for t in runs_of(name, start)})
    else:
        rows, stop = rows.join(labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("block").alias("bad")), "page_id", "left"), []
    rows = common.materialise(rows, "url-pages")
    scores, prior = train(rows.where("host <> ''"), words, stop)
    known = {r["t"]: r["score"] for r in scores.orderBy(F.desc("n"), "t").limit(head).collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            runs = [runs_of(h, p) for h, p in zip(b["host"], b["path"])]
            score = [prior + sum(known.get(t, 0.0) for t in ts) if h else 0.0 for h, ts in zip(b["host"], runs)]
            yield b[["row", "host", "path"]].assign(score=score, rest=[[t for t in ts if t not in known] for ts in runs])

    found = rows.select("row", "host", "path").mapInPandas(run, "row long, host string, path string, score double, rest array<string>")
    scored = common.materialise(found, "url-scored")
    rest = scored.select("row", F.explode("rest").alias("t")).join(scores.select("t", F.col("score").alias("more")), "t").groupBy("row").agg(F.sum("more").alias("more"))
    late = scored.where("size(rest) > 0").join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    scored = scored.where("size(rest) = 0").unionByName(late).join(rows.select("row", "page_id"), "row")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
