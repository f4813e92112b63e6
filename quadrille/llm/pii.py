"""Personal data, in Spark SQL functions alone.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, part sizes for
addresses, digit counts for phones), and words close to a span raise the score of kinds that are weak on their own.
A text's matches and the pieces between them alternate, so running sums of their lengths give positions in code points.
Patterns whose repeats can't overlap what follows are possessive, which keeps matching linear and the stack flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (pattern, cheap test that any match passes)
BASE = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
EXTRA = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    "national_phone": (r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "[0-9]{3}[\x20.-][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]"),
}
#: Score of a confirmed span before its context, and words that raise it when they stand within REACH code points before it or after.
#: Spans of the same kind in between count as a space, so that one label serves a list of numbers.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_phone": 0.4, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank", "national_phone": "phone|call|tel|mobile|fax", "ssn": "ssn|social|security",
}
REACH, LIFT, KEEP = 40, 0.3, 0.6


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a sound Luhn checksum; false for an empty one."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return F.when(n > 0, F.coalesce(total % 10 == 0, F.lit(False))).otherwise(F.lit(False))


def mod97(iban: Column) -> Column:
    """Whether an IBAN, with spaces or without, leaves 1 modulo 97 after its first four characters move to the end."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    n = F.length(turned)

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) == 1, F.lit(False))


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(match)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,rank:int,kind:string,score:double>>"


_FOUND = "array<struct<start:int,end:int,match:string,context:string>>"


def _spans(kind: str, rank: int) -> Column:
    """Confirmed and scored spans of one kind from its columns of (match, gap before it, context)."""
    pairs = F.col(f"_pairs_{kind}")

    def walk(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        end = at + F.length(pair["match"])
        one = F.array(F.struct(at.alias("start"), end.alias("end"), pair["match"].alias("match"), pair["context"].alias("context")))
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    def block(acc: Column, i: Column) -> Column:  # slices keep the cost of growing arrays in proportion to the matches
        got = F.aggregate(F.slice(pairs, i, F.lit(200)), F.struct(acc["at"].alias("at"), F.array().cast(_FOUND).alias("found")), walk)
        return F.struct(got["at"].alias("at"), F.concat(acc["all"], F.array(got["found"])).alias("all"))

    outer = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_FOUND}>").alias("all"))
    found = F.flatten(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(200)), outer, block)["all"])
    sure = F.filter(found, lambda x: _confirmed(kind, x["match"]))
    scored = F.transform(sure, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
        (F.lit(PRIOR[kind]) + F.when(F.lower(x["context"]).rlike(rf"\b(?:{CONTEXT[kind]})"), F.least(F.lit(LIFT), F.lit(1 - PRIOR[kind]))).otherwise(F.lit(0.0))).alias("score"),
    ))
    return F.when(F.size(pairs) == 0, F.array().cast(_SPAN)).otherwise(scored.cast(_SPAN))


def _pairs(kind: str) -> Column:
    """(match, gap before it, context) of every match. What stands around a match is joined from the ends of the REACH gaps
    next to it, so its cost doesn't grow with the text."""
    matches, gaps = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")

    def pair(m: Column, i: Column) -> Column:
        before = F.transform(F.slice(gaps, F.greatest(i + 2 - REACH, F.lit(1)), F.least(i + 1, F.lit(REACH))), lambda g: F.right(g, F.lit(REACH)))
        after = F.transform(F.slice(gaps, i + 2, F.lit(REACH)), lambda g: F.left(g, F.lit(REACH)))
        context = F.concat(F.right(F.array_join(before, " "), F.lit(REACH)), F.lit("\n"), F.left(F.array_join(after, " "), F.lit(REACH)))
        return F.struct(m.alias("match"), F.element_at(gaps, i + 1).alias("gap"), context.alias("context"))

    return F.transform(matches, pair)


def _listed(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs(text, ...) as (row, text, base, spans): the row itself, its text, and arrays of (start, end, rank, kind, score), by
    start, then kind.

    The row travels as one struct, so that its columns may have any names. A null text is an empty one and has no spans.
    Base kinds stand whenever they are confirmed; the further kinds need a score of KEEP, which weak ones reach by a
    context word only, and give way where they overlap a base span. Repeated rows are judged alike.
    """
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = [*BASE, *EXTRA]
    # A column that the next projection reads more than once stays a step of its own, so regexes run once a text.
    for part, of in (("m", lambda k: F.regexp_extract_all("text", F.lit((BASE | EXTRA)[k][0]), F.lit(0))), ("g", lambda k: F.split("text", (BASE | EXTRA)[k][0], -1))):
        docs = docs.withColumns({f"_{part}_{k}": F.when(F.col("text").rlike((BASE | EXTRA)[k][1]), of(k)).otherwise(F.array().cast("array<string>")) for k in kinds})
    docs = docs.withColumns({f"_pairs_{k}": _pairs(k) for k in kinds}).drop(*[f"_{p}_{k}" for p in "mg" for k in kinds])
    docs = docs.withColumns({f"_{k}": _spans(k, rank) for rank, k in enumerate(kinds)}).drop(*[f"_pairs_{k}" for k in kinds])
    base = F.array_sort(F.concat(*[F.col(f"_{k}") for k in BASE]), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    docs = docs.withColumn("base", base)
    more = F.filter(F.concat(*[F.col(f"_{k}") for k in EXTRA]), lambda x: (x["score"] >= KEEP) & ~F.exists(F.col("base"), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    docs = docs.withColumn("_more", more).drop(*[f"_{k}" for k in kinds])
    every = F.when(F.size("_more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "_more"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])))
    return docs.withColumn("spans", every).drop("_more")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): counts of the base kinds, the digest of their places, all spans as text."""
    found = find_personal_data(docs.select("doc_id", "text"))
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return found.select("row.doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[%s]") -> DataFrame:
    """docs, whatever their columns, with every span of the text replaced by its kind; overlapping spans are replaced once,
    under the first. A null text stays null."""
    found = find_personal_data(docs)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        name = F.concat(F.lit(mark.split("%s")[0]), F.upper(x["kind"]), F.lit(mark.split("%s")[1]))
        return F.when(x["end"] <= acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.when(x["start"] >= acc["at"], F.concat(gap, name)).otherwise(F.lit(""))).alias("out")))

    done = F.aggregate(F.col("spans"), start, step)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text"))))
    text = F.when(F.col("row")["text"].isNotNull(), text)
    return found.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
