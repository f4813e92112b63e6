"""Packing by minimum bin slack.

Every document gives full windows and one remainder shorter than a window. Only the histogram of remainder lengths, of
fewer than `capacity` entries whatever the corpus, reaches the driver. There a bitset subset-sum dynamic program picks
the multiset of remaining lengths that fills the next window closest to capacity; counts are backtracked, and the
pattern is repeated while the counts last. A gap that no remaining length fits is closed by cutting one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import BYTE_BPE, encoder, vocabulary_path


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset within `counts` whose sum is at most `capacity` and closest to it, as length -> count.

    reached is a bitset of sums; each length enters in powers of two of its count, so that a length of count c costs
    about log2(c) shifts. The sets before each step are kept for backtracking.
    """
    mask = (1 << (capacity + 1)) - 1
    reached, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reached))
            reached |= (reached << (length * k)) & mask
            left -= k
            k *= 2
        if reached >> capacity & 1:
            break
    at, used = reached.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Place `histogram[length]` remainders of each length; returns (intervals, number of sequences).

    An interval row is (length of the remainder, start in it, piece length, first rank, end rank, index of the first
    within its pattern's slot, pieces of this length per window, first sequence, offset in the sequence): the piece of
    rank r is number j = index + r - first rank, lies in sequence first + j // per and at offset + j % per * length.
    """
    stock: dict[int, list[list[int]]] = {}  # piece length -> [[remainder length, start, first rank, end rank]]
    counts: dict[int, int] = {}
    for length, n in sorted(histogram.items()):
        if n and length:
            stock[length], counts[length] = [[length, 0, 0, n]], n
    rows: list[tuple] = []
    sequence = 0

    def take(length: int, n: int, per: int, offset: int, whole: int) -> None:
        """Place n pieces of which `whole` tokens each go here; the rest of each piece returns to the stock."""
        counts[length] -= n
        j = 0
        while n:
            run = stock[length][-1]
            m = min(n, run[3] - run[2])
            rows.append((run[0], run[1], whole, run[2], run[2] + m, j, per, sequence, offset))
            if whole < length:
                stock.setdefault(length - whole, []).append([run[0], run[1] + whole, run[2], run[2] + m])
                counts[length - whole] = counts.get(length - whole, 0) + m
            run[2] += m
            j += m
            n -= m
            if run[2] == run[3]:
                stock[length].pop()
        if not counts[length]:
            del counts[length]
            if not stock.get(length):
                stock.pop(length, None)

    while counts:
        total = sum(k * n for k, n in counts.items())
        room = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        first = max(counts)
        used: dict[int, int] = {}
        if first <= room:
            used = best_fill({**counts, first: counts[first] - 1} if counts[first] > 1 else {k: n for k, n in counts.items() if k != first}, room - first)
            used[first] = used.get(first, 0) + 1
        gap = room - sum(k * n for k, n in used.items())
        cut = 0
        if gap:
            cut = max((k for k, n in counts.items() if n > used.get(k, 0) and k > gap), default=0)
        repeat = min([counts[k] // n for k, n in used.items()] or [counts[cut]])
        if cut:
            repeat = min(repeat, counts[cut] // (used.get(cut, 0) + 1))
        repeat = max(1, min(repeat, total // room))
        offset = 0
        for k in sorted(used, reverse=True):
            take(k, used[k] * repeat, used[k], offset, k)
            offset += k * used[k]
        if cut:
            take(cut, repeat, 1, offset, gap)
        sequence += repeat
    table = np.array(rows, dtype=np.int64).reshape(-1, 9)
    return table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))], sequence


def locate(plan: np.ndarray, length: np.ndarray, rank: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of remainders: yields (row numbers, start, piece length, sequence, offset) until all are placed."""
    shift = 40
    keys = ((plan[:, 0] * (capacity + 1) + plan[:, 1]) << shift) + plan[:, 3]
    who = np.flatnonzero(length > 0)
    start = np.zeros(len(who), dtype=np.int64)
    while len(who):
        row = plan[np.searchsorted(keys, ((length[who] * (capacity + 1) + start) << shift) + rank[who], side="right") - 1]
        j = row[:, 5] + rank[who] - row[:, 3]
        yield who, start, row[:, 2], row[:, 7] + j // row[:, 6], row[:, 8] + j % row[:, 6] * row[:, 2]
        start = start + row[:, 2]
        more = start < length[who]
        who, start = who[more], start[more]


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = 1024, with_ids: bool = False, small: int = 4096) -> DataFrame:
    """Pack docs(doc_id, text): per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text is an empty one (its end id alone), a null or repeated doc_id is a document of its own. Sequences
    are full but for at most ten, which are powers of two. Token ids are written once to the shared folder and don't
    move again: ranks within a length count within a task first, and each task's sums over the tasks before it (one row
    of at most `capacity` numbers) are broadcast where there are at most `small` tasks, else joined by a shuffle.
    """
    spark = docs.sparkSession
    common.ship(spark)
    vocabulary = vocabulary or vocabulary_path(BYTE_BPE)
    kind = "task long, doc_id long, doc_tokens long, rest long, rank long, whole_before long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, task = encoder(vocabulary), np.asarray([end_id], dtype="<u2").tobytes(), TaskContext.get().partitionId()
        seen, full = [0] * capacity, 0
        for b in common.slices(batches):
            ids = [x + end for x in enc.encode(common.strings(b.column("text")))]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            rest, rank = n % capacity, np.zeros(len(n), dtype=np.int64)
            for i, r in enumerate(rest.tolist()):
                rank[i] = seen[r]
                seen[r] += 1
            whole = n // capacity
            columns = [np.full(len(n), task, dtype=np.int64), b.column("doc_id"), n, rest, rank, full + np.cumsum(whole) - whole, pa.array(ids, pa.binary())]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in kind.split(", ")])
            full += int(whole.sum())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = common.materialise(texts.mapInArrow(encode, kind), "packing-ids")

    per = common.materialise(coded.groupBy("task", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / capacity)).cast("long").alias("whole")), "packing-counts")
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select("task", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    ranks = ranks.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("rest", "rank_before"))).alias("ranks"))  # at most `capacity` entries
    wholes = common.prefix_sums(per.groupBy("task").agg(F.sum("whole").alias("whole")), "task", ["whole"]).select("task", F.col("whole_before").alias("task_before"))
    histogram = {r["rest"]: r["n"] for r in per.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # fewer than capacity rows
    plan, packed = plan_windows(histogram, capacity)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            n, rest, rank, first = (b.column(c).to_numpy() for c in ("doc_tokens", "rest", "rank", "first"))
            raw = b.column("ids").to_pylist()
            whole = n // capacity
            who = np.repeat(np.arange(len(n)), whole)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(whole) - whole, whole)
            parts = [(who, nth * capacity, np.full(len(who), capacity), first[who] + nth, np.zeros(len(who), dtype=np.int64))]
            parts += [(w, whole[w] * capacity + s, k, q, o) for w, s, k, q, o in locate(plan, rest, rank, capacity)]
            who, start, size, sequence, offset = (np.concatenate(x) for x in zip(*parts))
            for at in range(0, len(who), 8192):
                cut = slice(at, at + 8192)
                ids = [np.frombuffer(raw[w], "<u2", k, 2 * s).astype("<u4") for w, s, k in zip(who[cut].tolist(), start[cut].tolist(), size[cut].tolist())]
                out = [b.column("doc_id").take(pa.array(who[cut])), start[cut], size[cut], [zlib.crc32(x) for x in ids], n[who[cut]], sequence[cut], offset[cut]]
                out = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in out] + ([pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))] if with_ids else [])
                yield pa.record_batch(out, [c.split()[0] for c in schema.split(", ")])

    tasks = ranks.join(wholes, "task")
    if per.select("task").distinct().count() <= small:
        tasks = F.broadcast(tasks)
    placed = coded.join(tasks, "task").select(
        "doc_id", "doc_tokens", "rest", "ids", (F.col("rank") + F.element_at("ranks", F.col("rest"))).alias("rank"), (F.col("whole_before") + F.col("task_before") + F.lit(packed)).alias("first")
    )
    return common.materialise(placed.mapInArrow(pieces, schema), "packing-pieces")
