"""Token-ID output: one wavelet matrix per shard.

A shard's ids become `bits` succinct bit-planes, most significant bit first; every plane is partitioned stably by the
bits of the plane above. A directory of ones per 512 bits gives rank, and binary search over it select, so the one
file answers access, counting and occurrence lookup without expanding it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import WORD_BPE, encoder, vocabulary_path

_HEAD = struct.Struct("<4sIQQ")
_SPAN = 512  # bits per entry of the rank directory
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class WaveletMatrix:
    def __init__(self, n: int, bits: int, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        width = -(-n // _SPAN) * (_SPAN // 8)
        planes, zeros = np.zeros((bits, width), dtype=np.uint8), np.zeros(bits, dtype=np.int64)
        seq = ids.astype(np.uint32 if bits > 16 else np.uint16)
        for level in range(bits):
            one = (seq & seq.dtype.type(1 << (bits - 1 - level))).astype(bool)
            packed = np.packbits(one)
            planes[level, : len(packed)] = packed
            after = seq.take(np.flatnonzero(one))  # positions, then take: masks would mispredict every other bit
            before = seq.take(np.flatnonzero(~one))
            zeros[level] = len(before)
            seq = np.concatenate((before, after))
        return cls(n, bits, zeros, planes, cls._directory(planes))

    @staticmethod
    def _directory(planes: np.ndarray) -> np.ndarray:
        bits, width = planes.shape
        ones = np.bitwise_count(planes.view(np.uint64)).reshape(bits, width // (_SPAN // 8), _SPAN // 64).sum(axis=2, dtype=np.int64)
        return np.concatenate((np.zeros((bits, 1), dtype=np.int64), np.cumsum(ones, axis=1)), axis=1).astype("<u4")

    def to_bytes(self) -> bytes:
        return b"".join((_HEAD.pack(b"WMX1", self.bits, self.n, self.planes.shape[1]), self.zeros.astype("<i8").tobytes(), self.ranks.tobytes(), self.planes.tobytes()))

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        magic, bits, n, width = _HEAD.unpack_from(raw)
        if magic != b"WMX1":
            raise ValueError("not a wavelet matrix")
        at = _HEAD.size
        zeros = np.frombuffer(raw, "<i8", bits, at)
        at += 8 * bits
        spans = width // (_SPAN // 8) + 1
        ranks = np.frombuffer(raw, "<u4", bits * spans, at).reshape(bits, spans)
        at += 4 * bits * spans
        planes = np.frombuffer(raw, np.uint8, bits * width, at).reshape(bits, width)
        return cls(n, bits, zeros, planes, ranks)

    def tokens(self) -> np.ndarray:
        """The whole sequence: planes are merged from the last to the first, each undoing one stable partition."""
        seq = np.zeros(self.n, dtype=np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            merged, z = np.empty_like(seq), self.zeros[level]
            merged[np.flatnonzero(~one)] = seq[:z]
            merged[np.flatnonzero(one)] = seq[z:] | seq.dtype.type(1 << (self.bits - 1 - level))
            seq = merged
        return seq

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        span = at // _SPAN
        count = self.ranks[level][span].astype(np.int64)
        step = _SPAN // 8
        start, stop = span * step, at >> 3
        plane = self.planes[level]
        for k in range(step):
            inside = start + k < stop
            if not inside.any():
                break
            count[inside] += _ONES[plane[(start + k)[inside]]]
        rest = at & 7
        some = rest > 0
        count[some] += _ONES[plane[stop[some]] >> (8 - rest[some]).astype(np.uint8)]
        return count

    def access(self, at) -> np.ndarray:
        at = np.atleast_1d(np.asarray(at, dtype=np.int64))
        out = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._rank1(level, at)
            out = (out << 1) | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def ranks_of(self, token: int, ends) -> np.ndarray:
        """Occurrences of the token before each of the positions `ends`."""
        return self._descend(token, ends)[1]

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token before position `end`."""
        return int(self.ranks_of(token, [end])[0])

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _descend(self, token: int, ends) -> tuple[int, np.ndarray]:
        """(where the token's run starts past the last plane, its occurrences before each position)."""
        at = np.concatenate(([0], np.minimum(np.asarray(ends, dtype=np.int64), self.n)))
        if token < 0 or token >> self.bits:
            return 0, np.zeros(len(at) - 1, dtype=np.int64)
        for level in range(self.bits):
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else at - ones
        return int(at[0]), at[1:] - at[0]

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0); -1 if there is none."""
        low, found = self._descend(token, [self.n])
        if not 0 <= k < found[0]:
            return -1
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self._select(level, one, at - (self.zeros[level] if one else 0))
        return int(at)

    def _select(self, level: int, one: int, k: int) -> int:
        ones = self.ranks[level].astype(np.int64)
        before = ones if one else np.arange(len(ones)) * _SPAN - ones
        span = int(np.searchsorted(before, k, side="right")) - 1
        step = _SPAN // 8
        bits = np.unpackbits(self.planes[level][span * step : (span + 1) * step])
        return span * _SPAN + int(np.flatnonzero(bits == one)[k - before[span]])


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One file: numbers of documents and of those without an id, which come first, their ids and lengths, then the matrix
    of all their tokens."""
    nulls = doc_ids.count(None)
    names = np.array([0] * nulls + doc_ids[nulls:], dtype="<i8")
    return struct.pack("<QQ", len(doc_ids), nulls) + names.tobytes() + lengths.astype("<i8").tobytes() + WaveletMatrix.build(ids, bits).to_bytes()


def unpack_shard(raw: bytes) -> tuple[np.ndarray, int, np.ndarray, WaveletMatrix]:
    n, nulls = struct.unpack_from("<QQ", raw)
    return np.frombuffer(raw, "<i8", n, 16), nulls, np.frombuffer(raw, "<i8", n, 16 + 8 * n), WaveletMatrix.from_bytes(raw[16 + 16 * n :])


def write_shards(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, shard_tokens: int = 2_000_000, range_bytes: int = 16 << 20, bits: int = 16) -> DataFrame:
    """Encode docs(doc_id, text) and write wavelet shards in ascending doc_id order to the shared folder.

    Returns the files as read back: (shard long, ascending in doc_id; n_tokens long; payload binary). Documents without
    a doc_id come first; a null text is an empty one; rows that repeat a doc_id keep one entry each, in the order of a
    hash of their texts. A shard file holds `shard_tokens` tokens at most unless one document is longer.

    Texts are dealt to ranges of (doc_id, hash of the text, row), as many as their stored size has `range_bytes`, so that
    neither a hot doc_id nor growth fills a task; a task encodes its range and writes its files in one pass.
    """
    spark = docs.sparkSession
    common.ship(spark)
    vocabulary = vocabulary or vocabulary_path(WORD_BPE)
    ranges = max(common.parallelism(spark), -(-common.size_in_bytes(docs.select("doc_id", "text")) // range_bytes))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, shard = encoder(vocabulary), np.asarray([end_id], dtype="<u2").tobytes(), TaskContext.get().partitionId() << 24
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            raw = pack_shard(names, np.array([len(x) // 2 for x in held], dtype=np.int64), np.frombuffer(b"".join(held), "<u2"), bits)
            return pa.record_batch([pa.array([shard], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], ["shard", "n_tokens", "payload"])

        for b in common.slices(batches):
            for d, x in zip(b.column("doc_id").to_pylist(), enc.encode(common.strings(b.column("text")))):
                x += end
                if held and size + len(x) // 2 > shard_tokens:
                    yield flush()
                    names, held, size, shard = [], [], 0, shard + 1
                names.append(d)
                held.append(x)
                size += len(x) // 2
        if held:
            yield flush()

    dealt = docs.repartitionByRange(ranges, F.asc_nulls_first("doc_id"), "hash", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash", "row")
    return common.materialise(dealt.select("doc_id", "text").mapInArrow(build, "shard long, n_tokens long, payload binary"), "wavelet")


def _on_files(files: DataFrame, schema: str, rows_of) -> DataFrame:
    """rows_of(matrix, doc_ids, number without an id, lengths) of every file as columns, behind the shard's number."""
    common.ship(files.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 1):
            doc_ids, nulls, lengths, matrix = unpack_shard(b.column("payload")[0].as_py())
            columns = rows_of(matrix, doc_ids, nulls, lengths)
            yield pa.record_batch([pa.array(np.full(len(columns[0]), b.column("shard")[0].as_py())), *columns], names)

    return common.materialise(files.select("shard", "payload").mapInArrow(run, schema), "wavelet-rows")


def _named(doc_ids: np.ndarray, nulls: int) -> pa.Array:
    return pa.array(doc_ids, mask=np.arange(len(doc_ids)) < nulls)


def starts(files: DataFrame) -> DataFrame:
    """(shard, before): tokens of all files before each; one row a file, summed by blocks."""
    return common.prefix_sums(files.select("shard", "n_tokens"), "shard", ["n_tokens"], block=1 << 24).select("shard", F.col("n_tokens_before").alias("before"))


def read_digests(files: DataFrame, end_id: int = 2) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, n_end (occurrences of end_id, by rank)."""

    def digest(matrix: WaveletMatrix, doc_ids: np.ndarray, nulls: int, lengths: np.ndarray) -> list[pa.Array]:
        ids = matrix.tokens().astype("<u4")
        ends = np.cumsum(lengths)
        local = ends - lengths
        crc = [zlib.crc32(ids[s:e]) for s, e in zip(local.tolist(), ends.tolist())]
        return [_named(doc_ids, nulls), pa.array(local), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(matrix.ranks_of(end_id, ends) - matrix.ranks_of(end_id, local))]

    rows = _on_files(files, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long, n_end long", digest)
    return rows.join(starts(files), "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "n_end")


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each token in all files, by rank alone; 0 where there is none."""

    def count(matrix: WaveletMatrix, doc_ids: np.ndarray, nulls: int, lengths: np.ndarray) -> list[pa.Array]:
        return [pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())]

    wanted = files.sparkSession.createDataFrame([(t,) for t in tokens], "token long")
    return wanted.join(_on_files(files, "shard long, token long, n long", count).groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def find_token(files: DataFrame, token: int) -> DataFrame:
    """(doc_id, at, position): every occurrence of the token, by select: its place in its document and among all tokens."""

    def find(matrix: WaveletMatrix, doc_ids: np.ndarray, nulls: int, lengths: np.ndarray) -> list[pa.Array]:
        where = np.array([matrix.select(token, k) for k in range(matrix.count(token))], dtype=np.int64)
        ends = np.cumsum(lengths)
        doc = np.searchsorted(ends, where, side="right")
        return [_named(doc_ids, nulls).take(pa.array(doc)), pa.array(where - (ends - lengths)[doc]), pa.array(where)]

    rows = _on_files(files, "shard long, doc_id long, at long, local long", find)
    return rows.join(starts(files), "shard").select("doc_id", "at", (F.col("before") + F.col("local")).alias("position"))
