"""Approximate nearest neighbours by additive quantisation.

A vector is a coarse codeword plus its residual's length times a sum of full-dimensional codewords, one of each
residual codebook, chosen by beam search. As directions are coded apart from lengths, tight clusters are resolved as
finely as wide ones. The squared norm of the coded direction and its product with the coarse codeword are stored, so a
query scores all rows from lookup tables; the best of each part of the rows are reranked on original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * (x @ words.T)).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, words)
        n = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words[n > 0] = total[n > 0] / n[n > 0, None]
        words[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return words


class AdditiveQuantiser:
    def __init__(self, coarse: np.ndarray, books: np.ndarray, beam: int):
        self.coarse, self.books, self.beam = coarse, books, beam

    @classmethod
    def fit(cls, sample: np.ndarray, books: int = 23, words: int = 256, rounds: int = 4, beam: int = 2, seed: int = 3) -> AdditiveQuantiser:
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float64)
        coarse = _kmeans(x, words, rounds, rng)
        x = x - coarse[_nearest(x, coarse)]
        size = np.linalg.norm(x, axis=1)
        x = x[size > 0] / size[size > 0, None]
        found = []
        for _ in range(books):
            if len(x):
                found.append(_kmeans(x, words, rounds, rng))
                x = x - found[-1][_nearest(x, found[-1])]
        d = sample.shape[1]
        full = np.zeros((len(found), words, d))
        for i, b in enumerate(found):
            full[i, : len(b)] = b
            full[i, len(b) :] = b[0]
        return cls(coarse, full, beam)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(coarse number, codes, residual length, squared norm of the coded direction, its product with the coarse word)."""
        near = _nearest(x, self.coarse)
        rest = x - self.coarse[near]
        size = np.linalg.norm(rest, axis=1)
        u = rest / np.maximum(size, 1e-300)[:, None]
        n, m = len(x), len(self.books)
        left, loss, codes = u[:, None, :], np.zeros((n, 1)), np.zeros((n, 1, m), dtype=np.uint8)
        rows = np.arange(n)[:, None]
        for k, book in enumerate(self.books):
            gain = (book**2).sum(axis=1) - 2 * (left.reshape(-1, x.shape[1]) @ book.T).reshape(n, left.shape[1], -1)
            total = (loss[:, :, None] + gain).reshape(n, -1)
            best = np.argpartition(total, min(self.beam, total.shape[1]) - 1, axis=1)[:, : self.beam]
            parent, word = best // len(book), best % len(book)
            loss = total[rows, best]
            codes = codes[rows, parent]
            codes[:, :, k] = word
            left = left[rows, parent] - book[word]
        pick = loss.argmin(axis=1)
        coded = u - left[np.arange(n), pick]
        return near.astype(np.int32), codes[np.arange(n), pick], size, (coded**2).sum(axis=1), (coded * self.coarse[near]).sum(axis=1)

    def scores(self, q: np.ndarray, near: np.ndarray, codes: np.ndarray, size: np.ndarray, norm: np.ndarray, cross: np.ndarray) -> Iterator[np.ndarray]:
        """Approximate squared distances of each query to all coded rows."""
        columns = np.ascontiguousarray(codes.T).astype(np.intp)
        for one in q:
            table = self.books @ one
            dot = np.zeros(len(near))
            for k in range(len(self.books)):
                dot += table[k][columns[k]]
            yield ((one - self.coarse) ** 2).sum(axis=1)[near] - 2 * size * (dot - cross) + size**2 * norm


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows that take part: no null, zero, or partly null or non-finite vectors."""
    x = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.where(~bad & F.exists("embedding", lambda v: v != 0))


def nearest(rows: DataFrame, k: int = 10, shortlist: int = 400, sample: int = 16_000, query_block: int = 2048) -> DataFrame:
    """Nearest neighbours of rows(vec_id, embedding) whose vec_id is divisible by 100, among all rows but their own.

    Returns query_id, rank, vec_id, score (the exact Euclidean distance), nearest first, ties to the smaller vec_id.
    Codebooks are fitted on at most about `sample` vectors, those of the lowest hash of vec_id; every row is coded.
    Vectors that aren't usable take no part; those of each length are searched among themselves. Rows that repeat a
    vec_id are candidates each, by their own vectors, but never for a query of that vec_id; of query rows that repeat
    one, that of the least vector asks.
    """
    spark = rows.sparkSession
    common.ship(spark)
    valid = usable(rows)
    lengths = [r["d"] for r in valid.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return found
    valid = valid.withColumn("row", F.monotonically_increasing_id())
    if len(lengths) > 1:
        valid = common.materialise(valid, "aq-vectors")
        for d in lengths:
            found = found.unionByName(_nearest_of(valid.where(F.size("embedding") == d), k, shortlist, sample, query_block))
        return found
    return _nearest_of(common.materialise(valid, "aq-vectors"), k, shortlist, sample, query_block)


def _nearest_of(valid: DataFrame, k: int, shortlist: int, sample: int, query_block: int) -> DataFrame:
    """nearest() of valid(vec_id, embedding, row), of one length, each under its own row number."""
    spark = valid.sparkSession
    total = valid.count()
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
    taken = valid.where(hashed < F.lit(int((1 << 30) * min(1.0, sample / total)))).select("row", "embedding").collect() if total > sample else valid.collect()
    taken = np.array([r["embedding"] for r in sorted(taken, key=lambda r: r["row"])], dtype=np.float64)
    if not len(taken):
        taken = np.array([r["embedding"] for r in valid.limit(1).collect()], dtype=np.float64)
    quantiser = AdditiveQuantiser.fit(taken)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                near, codes, size, norm, cross = quantiser.encode(np.stack(part["embedding"].to_list()))
                yield pd.DataFrame({"row": part["row"].to_numpy(), "vec_id": part["vec_id"].to_numpy(), "near": near, "codes": [c.tobytes() for c in codes], "size": size, "norm": norm, "cross": cross})

    index = common.materialise(valid.mapInPandas(code, "row long, vec_id long, near int, codes binary, size double, norm double, cross double"), "aq-index")
    queries = valid.where("vec_id % 100 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))
    queries = common.materialise(queries, "aq-queries")
    blocks = max(1, -(-queries.count() // query_block))
    path = common.fresh_dir(spark, "aq-shortlists")
    found_schema = "query_id long, part int, ids array<long>, scores array<double>"

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) > shortlist:
            edge = np.partition(scores, shortlist - 1)[shortlist - 1]
            some = np.flatnonzero(scores <= edge)
            ids, scores = ids[some], scores[some]
        order = np.lexsort((ids, scores))[:shortlist]
        return ids[order], scores[order]

    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # bounded: a block of queries
        if not own:
            continue
        names, vectors = np.array([r["query_id"] for r in own]), np.array([r["query"] for r in own])

        def scan(batches: Iterator[pd.DataFrame], names=names, vectors=vectors) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            held: list = [None] * len(names)
            for b in batches:
                ids, rows = b["vec_id"].to_numpy(), b["row"].to_numpy()
                codes = np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), -1)
                columns = [b[c].to_numpy() for c in ("near", "size", "norm", "cross")]
                for i, s in enumerate(quantiser.scores(vectors, columns[0], codes, *columns[1:])):
                    other = ids != names[i]
                    a, c = rows[other], s[other]
                    if held[i] is not None:
                        a, c = np.concatenate((held[i][0], a)), np.concatenate((held[i][1], c))
                    held[i] = best(a, c)
            part = TaskContext.get().partitionId() % 64
            for at in range(0, len(names), 256):
                got = [(names[i], part, *held[i]) for i in range(at, min(at + 256, len(names))) if held[i] is not None]
                if got:
                    yield pd.DataFrame(got, columns=["query_id", "part", "ids", "scores"])

        index.mapInPandas(scan, found_schema).write.mode("append").parquet(path)

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        ids, scores = best(np.concatenate(g["ids"].to_list()), np.concatenate(g["scores"].to_list()))
        return pd.DataFrame({"query_id": [g["query_id"].iloc[0]], "part": [0], "ids": [ids], "scores": [scores]})

    lists = spark.createDataFrame([], found_schema) if queries.isEmpty() else spark.read.schema(found_schema).parquet(path)
    lists = lists.groupBy("query_id", "part").applyInPandas(merge, found_schema).groupBy("query_id").applyInPandas(merge, found_schema)
    pairs = lists.select("query_id", F.explode("ids").alias("row"))
    pairs = pairs.join(valid, "row").join(queries, "query_id")
    far = F.sqrt(F.aggregate(F.zip_with("embedding", "query", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "row")
    ranked = pairs.select("query_id", "vec_id", "row", far.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
