"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with single spaces between words. Per language, character n-grams up to ORDER get
interpolated Kneser-Ney probabilities: raw counts at the highest order, continuation counts below, one absolute
discount per order. All n-grams of an order that any language has seen lie in one sorted array of 64-bit hashes, with
a directory by leading bits; its rows hold every language's full log-probability. A text's language is that of the
lowest cross-entropy per character; a text whose lowest one exceeds what held-out texts of the sample show is rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 4
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)
_FLOOR = np.float32(np.log(1e-6))  # of a character that no text of the sample has


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _letters() -> np.ndarray:
    return common.worker_cache("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, number of the text of each; -1 for the ORDER - 1 spaces before each text)."""
    pad = ORDER - 1
    joined = "".join(["\0" * pad + t.replace("\0", " ").lower() for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cut, letter = codes == 0, _letters()[codes]
    keep = letter | cut
    keep[1:] |= letter[:-1]
    cut, letter = cut[keep], letter[keep]
    codes = np.where(letter, codes[keep], np.uint32(32))
    doc = np.cumsum(cut, dtype=np.int64) // pad - 1
    doc[cut] = -1
    return codes, doc


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """hashes[k][i]: of the k + 1 characters that end at i."""
    x = codes.astype(np.uint64) + _U(1)
    out, total = [], np.zeros(len(x), dtype=np.uint64)
    for k in range(ORDER):
        total = total.copy()
        total[k:] += x[: len(x) - k] * _U(pow(int(_B), k, 1 << 64))
        out.append(_mix(total + _U(k)))
    return out


class Table:
    """Rows found by 64-bit hash: a sorted array with a directory by leading bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = _U(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.longest = int(np.diff(np.append(self.start, len(keys))).max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(self.start[(wanted >> self.shift).astype(np.int64)], len(self.keys) - 1)
        found = np.where(self.keys[at] == wanted, at, -1)
        open_ = np.flatnonzero((found < 0) & (self.keys[at] < wanted))
        for step in range(1, self.longest):
            if not len(open_):
                break
            next_ = np.minimum(at[open_] + step, len(self.keys) - 1)
            seen = self.keys[next_]
            hit = seen == wanted[open_]
            found[open_[hit]] = next_[hit]
            open_ = open_[seen < wanted[open_]]
        return found


class LanguageModel:
    def __init__(self, languages: list[str], grams: list[Table], contexts: list[Table], limit: float):
        self.languages, self.grams, self.contexts, self.limit = languages, grams, contexts, limit

    def losses(self, texts: list[str], step: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
        """(summed negative log-probabilities by text and language, characters of each text); bounded by `step`."""
        loss, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < step):
                chars += len(texts[end])
                end += 1
            codes, doc = normalised(texts[at:end])
            for a in range(0, len(codes), step):
                low = max(0, a - ORDER + 1)  # what stands before a cut is context only
                part = doc[low : a + step].copy()
                part[: a - low] = -1
                self._add(codes[low : a + step], part, loss[at:end], size[at:end])
            at = end
        return loss, size

    def _add(self, codes: np.ndarray, doc: np.ndarray, loss: np.ndarray, size: np.ndarray) -> None:
        h = hashes(codes)
        where = np.flatnonzero(doc >= 0)
        if not len(where):
            return
        value = np.zeros((len(where), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(where))
        for k in range(ORDER - 1, -1, -1):
            row = self.grams[k].find(h[k][where[todo]])
            hit = row >= 0
            value[todo[hit]] += self.grams[k].rows[row[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k:
                row = self.contexts[k].find(h[k - 1][where[todo] - 1])
                hit = row >= 0
                value[todo[hit]] += self.contexts[k].rows[row[hit]]
            else:
                value[todo] += _FLOOR
        owner = doc[where]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        loss[owner[first]] -= np.add.reduceat(value, first, axis=0, dtype=np.float64)
        size[owner[first]] += np.diff(np.append(first, len(owner)))

    def predict(self, texts: list[str]) -> pd.DataFrame:
        loss, size = self.losses(texts)
        rate = loss / np.maximum(size, 1)[:, None]
        best = rate.argmin(axis=1)
        low = rate[np.arange(len(texts)), best]
        score = 1 / np.exp(-(rate - low[:, None]) * np.minimum(size, 200)[:, None]).sum(axis=1)
        empty = size == 0
        return pd.DataFrame({
            "lang_pred": np.where(empty, "und", np.array(self.languages, dtype=object)[best]),
            "score": np.where(empty, 0.0, score), "cross_entropy": np.where(empty, 0.0, low), "rejected": empty | (low > self.limit),
        })


def fit(texts: dict[str, list[str]]) -> LanguageModel:
    """A model from texts by language; every fifth text is kept from counting and calibrates rejection."""
    languages = sorted(texts)
    grams: list[dict[str, tuple]] = [{} for _ in range(ORDER)]
    for lang in languages:
        own = [t for i, t in enumerate(texts[lang]) if i % 5 or len(texts[lang]) < 5]
        codes, doc = normalised(own)
        h, where = hashes(codes), np.flatnonzero(doc >= 0)
        for k in range(ORDER):
            gram, at, n = np.unique(h[k][where], return_index=True, return_counts=True)
            at = where[at]
            suffix = h[k - 1][at] if k else np.zeros(len(at), dtype=np.uint64)
            context = h[k - 1][at - 1] if k else np.zeros(len(at), dtype=np.uint64)
            grams[k][lang] = (gram, n.astype(np.float64), context, suffix)
    models: list[tuple[dict, dict]] = []  # by order: language -> (grams, probabilities), (contexts, weights)
    keys: list[np.ndarray] = []
    tables, contexts = [], []
    for k in range(ORDER):
        every = np.unique(np.concatenate([grams[k][x][0] for x in languages])) if languages else np.zeros(0, dtype=np.uint64)
        # context and suffix of each n-gram, from any language that has it
        context_of, suffix_of = np.zeros(len(every), dtype=np.uint64), np.zeros(len(every), dtype=np.uint64)
        for lang in languages:
            gram, _, context, suffix = grams[k][lang]
            at = np.searchsorted(every, gram)
            context_of[at], suffix_of[at] = context, suffix
        all_contexts = np.unique(context_of)
        value = np.zeros((len(every), len(languages)), dtype=np.float64)
        weight = np.ones((len(all_contexts), len(languages)))
        for j, lang in enumerate(languages):
            gram, n, context, _ = grams[k][lang]
            if k < ORDER - 1:  # continuation counts: how many characters stand before the n-gram
                longer = grams[k + 1][lang][3]
                kinds, many = np.unique(longer, return_counts=True)
                pos = np.minimum(np.searchsorted(kinds, gram), max(len(kinds) - 1, 0))
                n = np.where(kinds[pos] == gram, many[pos], 1).astype(np.float64)
            ones, twos = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            discount = ones / (ones + 2 * twos) if ones + twos else 0.5
            discount = min(max(discount, 0.1), 0.9)
            c_at = np.searchsorted(all_contexts, context)
            total = np.bincount(c_at, weights=n, minlength=len(all_contexts))
            kinds = np.bincount(c_at, minlength=len(all_contexts))
            some = total > 0
            weight[some, j] = discount * kinds[some] / total[some]
            lower = np.exp(_FLOOR) if k == 0 else models[k - 1][lang][np.searchsorted(keys[k - 1], suffix_of)]
            direct = np.zeros(len(every))
            direct[np.searchsorted(every, gram)] = np.maximum(n - discount, 0) / total[c_at]
            value[:, j] = direct + weight[np.searchsorted(all_contexts, context_of), j] * lower
        keys.append(every)
        models.append({lang: value[:, j] for j, lang in enumerate(languages)})
        tables.append(Table(every, np.log(value).astype(np.float32)))
        contexts.append(Table(all_contexts, np.log(weight).astype(np.float32)) if k else Table(np.zeros(0, dtype=np.uint64), np.zeros((0, len(languages)), dtype=np.float32)))
    model = LanguageModel(languages, tables, contexts, float("inf"))
    rates = []
    for lang in languages:
        kept = texts[lang][::5]
        loss, size = model.losses(kept)
        rates.extend((loss.min(axis=1)[size >= 50] / size[size >= 50]).tolist())
    if rates:
        model.limit = float(1.5 * np.quantile(rates, 0.995) + 0.5)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 300, chars: int = 6_000_000) -> LanguageModel:
    """Fit on a bounded sample of docs(doc_id, text, lang) that aren't held out.

    The sample takes whole texts of each language in the order of a hash of doc_id: `per_language` at most, and after
    the first five no more than fit into `chars` characters together, so that a language of long texts alone is learned
    from fewer of them. Lengths are known before any text is read; only the sample is collected. Rows without text, lang
    or doc_id teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("h"), F.length("text").cast("long").alias("n"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit({})
    u = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * per_language / n + 20 / n)))])
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "n")
    rows = known.where(u < share[F.col("lang")])
    drawn = rows.select("lang", "h", "doc_id", "n", F.row_number().over(order).alias("k"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    drawn = drawn.where((F.col("k") <= per_language) & ((F.col("k") <= 5) | (F.col("sum") <= chars)))
    wanted = {(r["lang"], r["h"], r["doc_id"], r["n"]) for r in drawn.collect()}
    if not wanted:
        return fit({})
    ids = F.array(*[F.lit(h) for h in sorted({h for _, h, _, _ in wanted})])
    sample: dict[str, list[tuple]] = {}
    for r in rows.where(F.array_contains(ids, F.col("h"))).toLocalIterator():
        if (r["lang"], r["h"], r["doc_id"], r["n"]) in wanted:
            sample.setdefault(r["lang"], []).append((r["h"], r["doc_id"], r["text"]))
    model = fit({lang: [t for _, _, t in sorted(found)[:per_language]] for lang, found in sample.items()})
    del sample, wanted
    common.trim()
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs(doc_id, held_out, text) with lang_pred, score, cross_entropy and rejected for text.

    A null text, one without letters, and every text under a model that has learned nothing are `und`, score 0,
    rejected. Between languages of equal cross-entropy the first by name wins. Repeated rows are judged alike.
    """
    common.ship(docs.sparkSession)

    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "cross_entropy": pa.float64(), "rejected": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = common.strings(b.column("text"))
            if model.languages:
                found = model.predict(texts)
                columns = [pa.array(found[c].tolist(), t) for c, t in kinds.items()]
            else:
                columns = [pa.array([x] * len(texts), t) for x, t in zip(("und", 0.0, 0.0, True), kinds.values())]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), *columns], ["doc_id", "held_out", *kinds])

    schema = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
    return common.materialise(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema), "languages")


def language_id(docs: DataFrame) -> DataFrame:
    """Train on docs(doc_id, text, lang) and judge all of it."""
    model = train(docs)
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out()), model)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject; all of them if it has learned nothing."""
    if not model.languages:
        return docs
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield b.filter(pa.array(~model.predict(common.strings(b.column("text")))["rejected"].to_numpy(dtype=bool)))

    return common.materialise(docs.mapInArrow(run, docs.schema), "identified")
