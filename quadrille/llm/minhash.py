"""Near-duplicate detection by circulant MinHash.

Two permutations of a domain of D slots do for all signature coordinates: the first scatters a document's shingles,
the second, shifted circularly by k, gives coordinate k. Laid out in memory, the K values of one shingle are K
neighbouring cells of the second permutation, so a signature is the minimum over such slices. Coordinates are banded;
texts of equal shingle sets become one class before banding; links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DOMAIN_BITS = 20
BANDS, ROWS = 32, 6
WORDS = 5
#: Edges that one task joins; as Python objects some 100 MB.
SMALL_GRAPH = 200_000
#: Input for which a task writes a table of groups.
TABLE_BYTES = 16 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Shingler:
    """Distinct hashed word shingles of whole texts, many texts at once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        rng = np.random.default_rng(11)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.base, self.inverse = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.place = rng.integers(1, 1 << 63, words, dtype=np.uint64) | _U(1)
        self.powers = self.downs = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            up, down = np.full(n, self.base), np.full(n, self.inverse)
            up[0] = down[0] = 1
            self.powers, self.downs = np.cumprod(up), np.cumprod(down)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1_000_000):
                size += len(texts[end])
                end += 1
            out.extend(self._some([t.encode("utf-8", "surrogatepass").lower() for t in texts[at:end]]))
            at = end
        return out

    def _some(self, raws: list[bytes]) -> list[np.ndarray]:
        buf = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raws])
        gap = self.space[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        starts, stops = edge[0::2], edge[1::2]  # the buffer ends with a gap
        self._grow(len(buf) + 1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.byte[buf] * self.powers[: len(buf)], dtype=np.uint64)))
        word = _mix((sums[stops] - sums[starts]) * self.downs[starts] + (stops - starts).astype(np.uint64))
        first = np.searchsorted(starts, np.concatenate(([0], ends[:-1])))
        last = np.concatenate((first[1:], [len(starts)]))
        w = self.words
        windows = np.zeros(max(0, len(word) - w + 1), dtype=np.uint64)
        for k in range(w):
            windows += word[k : k + len(windows)] * self.place[k]
        windows = _mix(windows)
        found = []
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= w:
                found.append(np.unique(windows[a : b - w + 1]))
            elif b > a:
                short = np.array([b - a], dtype=np.uint64)
                for k in range(b - a):
                    short = short * self.base + word[a + k]
                found.append(_mix(short))
            else:
                found.append(np.zeros(0, dtype=np.uint64))
        return found


class Circulant:
    """Signatures of bands * rows coordinates from two permutations of 2^DOMAIN_BITS slots."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = DOMAIN_BITS):
        rng = np.random.default_rng(5)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.k = bands * rows
        self.first = rng.permutation(1 << bits)
        second = rng.permutation(1 << bits).astype(np.uint32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate((second, second[: self.k])), self.k)
        self.weights = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | _U(1)
        self.salts = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slots = self.first[(shingles >> _U(64 - self.bits)).astype(np.int64)]
        best = self.slices[slots[:512]].min(axis=0)
        for at in range(512, len(slots), 512):
            np.minimum(best, self.slices[slots[at : at + 512]].min(axis=0), out=best)
        return best

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        cells = signatures.astype(np.uint64).reshape(-1, self.bands, self.rows)
        return _mix((cells * self.weights).sum(axis=2, dtype=np.uint64) ^ self.salts).view(np.int64)


def tools() -> tuple[Shingler, Circulant]:
    """One of each per Python worker."""
    return common.worker_cache("minhash", lambda: (Shingler(), Circulant()))


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with n_shingles, print (of the set; null for an empty one) and keys (one per band) for text."""
    kept = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, circulant = tools()
        for b in common.slices(batches):
            sets = shingler.sets(common.strings(b.column("text")))
            some = [s for s in sets if len(s)]
            keys = iter(circulant.band_keys(np.stack([circulant.signature(s) for s in some]))) if some else iter(())
            found = [pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))]
            yield pa.record_batch([*(b.column(c) for c in names), *found], [*names, "n_shingles", "print", "keys"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_shingles long, print binary, keys array<long>")


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) of edges(u, v) by union and find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                if u != v:
                    x, y = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                    parent[max(x, y)] = min(x, y)
        kind = b.schema.field("u").type if parent else pa.binary()
        nodes = list(parent)
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.record_batch([pa.array(some, kind), pa.array([root(x) for x in some], kind)], ["node", "root"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, name: str, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the smallest node reachable.

    At most `small` edges are joined by one task, as rounds cost more than their work. More take alternating large-star and
    small-star steps, until no node has a smaller neighbour and another one; each round's edges are written to the shared folder, so that lineage
    stays short and lost executors cost no more than a round, and are deleted when the next ones are there. The least neighbours are written before they are joined:
    a join of two plain exchanges is one that adaptive execution can split where a node has very many edges.
    """
    if edges.count() <= small:
        return common.materialise(_joined(edges), name)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("most")), name + "-low")
        if low.where("m < u AND m <> most").isEmpty():
            common.drop(low)
            break
        large = both.where("v > u").join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, common.materialise(near.union(small_low.select("u", F.col("m").alias("v"))).distinct(), name)
        common.drop(low, before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def verified(nodes: list[bytes], sets: list[np.ndarray], left: np.ndarray, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links of near sets as a spanning forest: among all where all are `left`, else between left ones and the others.

    For one set at a time the members of all others are counted: exact sizes of intersections without a pair being formed.
    """
    n = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    every = np.concatenate(sets)
    alone, ones = left.all(), np.flatnonzero(left)
    if len(ones) > 1:
        _, cell = np.unique(every, return_inverse=True)
        mark = np.zeros(len(cell), dtype=bool)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in ones:
        if len(ones) > 1:
            own = cell[starts[x] : starts[x] + n[x]]
            mark[own] = True
            inside = mark[cell]
            mark[own] = False
        else:
            inside = sets[x][np.minimum(np.searchsorted(sets[x], every), n[x] - 1)] == every
        shared = np.add.reduceat(inside, starts, dtype=np.int64)
        near = 100 * shared >= percent * (n + n[x] - shared)
        near[x] = False
        if not alone:
            near &= ~left
        for y in np.flatnonzero(near):
            a, b = root(x), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield nodes[x], nodes[int(y)]


def _confirm(tasks: DataFrame, percent: int) -> DataFrame:
    """Verified links (u, v) among the texts of each task (g, i, j): rows (g, i, j, b, node, text), left where b = i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, _ = tools()
        held: dict[bytes, tuple[bool, str]] = {}
        key = None

        def flush() -> pa.RecordBatch:
            sets = shingler.sets([t for _, t in held.values()])
            found = list(verified(list(held), sets, np.array([x for x, _ in held.values()]), percent)) if len(held) > 1 else []
            return pa.record_batch([pa.array([u for u, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["u", "v"])

        for b in common.slices(batches):
            for g, i, j, own, node, text in zip(*(b.column(c).to_pylist() for c in ("g", "i", "j", "b", "node", "text"))):
                if (g, i, j) != key and held:
                    yield flush()
                    held = {}
                key = g, i, j
                held[node] = own == i, text
        if held:
            yield flush()

    n = common.parallelism(tasks.sparkSession)
    return tasks.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "u binary, v binary")


def _crossed(members: DataFrame, texts: DataFrame, percent: int, block: int, block_shingles: int, few: int) -> DataFrame:
    """Links among members(g, node, n, leader, root) that share a band g and are in different components (root).

    Members are gathered into clusters over stars, not pairs. In a cluster (or, where that moves less, in each of its
    bands) those outside of its largest component are compared with all, block by block of bounded shingles; every pair
    of blocks is a task of its own, so that no group meets in one task, and the largest component isn't compared with
    itself: work is linear in its size.
    """
    clusters = components(members.select(F.col("node").alias("u"), F.col("leader").alias("v")), "minhash-clusters")
    whole = members.select("node", "n", "root").distinct().join(clusters.select("node", F.col("root").alias("g")), "node")

    def sizes(groups: DataFrame) -> DataFrame:
        """By group: its largest component, the members in others (k), numbers of blocks of both, rows that tasks would read."""
        per = groups.groupBy("g", "root").agg(F.count("*").alias("c"), F.max("n").alias("most")).groupBy("g")
        per = per.agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("m"), F.max("most").alias("most"))
        # a quarter of a block in small groups, so that these too are dealt to many tasks
        texts = F.least(F.lit(block), F.greatest(F.lit(-(-block // 4)), F.ceil(F.col("m") / 32)))
        size = F.greatest(F.lit(1), F.least(texts, F.floor(F.lit(block_shingles) / F.col("most"))))
        per = per.select("g", F.col("top.root").alias("main"), (F.col("m") - F.col("top.c")).alias("k"), F.col("top.c").alias("c"), size.alias("size"))
        per = per.withColumns({"nk": F.ceil(F.col("k") / F.col("size")).cast("int"), "nc": F.ceil(F.col("c") / F.col("size")).cast("int")})
        return per.withColumn("cost", F.col("k") * (F.col("nk") + F.col("nc")) + F.col("c") * F.col("nk"))

    of_clusters = common.materialise(sizes(whole).coalesce(few), "minhash-sizes")
    of_bands = common.materialise(sizes(members).coalesce(few), "minhash-band-sizes")
    home = members.groupBy("g").agg(F.min("leader").alias("node")).join(clusters, "node").select("g", F.col("root").alias("cluster"))
    by_band = of_bands.join(home, "g").groupBy("cluster").agg(F.sum("cost").alias("band_cost"))
    choice = by_band.join(of_clusters.select(F.col("g").alias("cluster"), "cost"), "cluster").select("cluster", (F.col("cost") <= F.col("band_cost")).alias("whole"))
    choice = common.materialise(choice.coalesce(few), "minhash-choice")

    def tasks(groups: DataFrame, per: DataFrame) -> DataFrame:
        rows = groups.join(per, "g").withColumn("minor", F.col("root") != F.col("main"))
        b = F.when(F.col("minor"), F.pmod(F.xxhash64("node"), F.col("nk"))).otherwise(F.col("nk") + F.pmod(F.xxhash64("node"), F.greatest(F.col("nc"), F.lit(1))))
        last = F.when(F.col("minor"), F.col("nk") + F.col("nc")).otherwise(F.col("nk")) - 1
        rows = rows.where("k > 0").select("g", "node", b.cast("int").alias("b"), F.explode(F.sequence(F.lit(0), last)).alias("t"))
        return rows.select("g", F.least("b", "t").alias("i"), F.greatest("b", "t").alias("j"), "b", "node")

    bands = members.select("g", "node", "root").join(home.join(choice.where("NOT whole"), "cluster").select("g"), "g")
    every = tasks(whole, of_clusters.join(choice.where("whole").select(F.col("cluster").alias("g")), "g"))
    every = every.unionByName(tasks(bands, of_bands).withColumn("g", F.col("g").cast("string").cast("binary")))
    return _confirm(every.join(texts, "node"), percent)


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = 512, block_shingles: int = 4_000_000, extra: tuple[str, ...] = ()) -> DataFrame:
    """Class of every row of docs(doc_id, text): doc_id, the columns `extra`, n_shingles, component_id, kept, first.

    A null text is an empty one. Empty sets are linked with nothing. A row without a doc_id isn't linked: its
    component_id is null and it is kept. Rows that repeat a doc_id are judged each by its own text, as sets, not ids, are
    what is linked; `kept` holds for all of a component that bear its smallest doc_id, `first` for those of them with
    one set of shingles. An empty table gives an empty result; ties can't arise, as sets' prints order all choices.

    Candidates share a band. Each is first compared with one leader of its band, the member that shares most bands, as an
    original does with its copies; chunk by chunk, so this is linear in the size of a group and links all copies of it. Only in bands whose members are still in different
    components are those outside of the largest one compared with all others, block by block.
    """
    spark = docs.sparkSession
    common.ship(spark)
    # groups' rows are few: their tables take tasks by the size of the input, not one for each shuffle partition
    few = max(2 * spark.sparkContext.defaultParallelism, -(-common.size_in_bytes(docs) // TABLE_BYTES) or common.parallelism(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), *extra)
    sketch = common.materialise(_sketch(rows), "minhash-sketch")
    classes = sketch.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print")
    classes = classes.agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = common.materialise(classes.select(F.col("print").alias("node"), "at.doc_id", "at.text_hash", "copies", "n", "keys").coalesce(few), "minhash-classes")
    bands = classes.select("node", "n", F.explode("keys").alias("g"))
    shared = bands.groupBy("g").agg(F.count("*").alias("m"), F.max("n").alias("most")).where("m > 1")
    members = common.materialise(bands.join(common.materialise(shared.coalesce(few), "minhash-shared"), "g"), "minhash-bands")
    mass = common.materialise(members.groupBy("node").agg(F.sum("m").alias("mass")).coalesce(few), "minhash-mass")
    shared = members.join(mass, "node").groupBy("g").agg(F.max(F.struct("mass", "node")).alias("top"), F.first("m").alias("m"), F.first("most").alias("most"))
    shared = common.materialise(shared.select("g", F.col("top.node").alias("leader"), "m", "most").coalesce(few), "minhash-shared")
    members = common.materialise(members.select("g", "node", "n").join(shared, "g"), "minhash-members")

    def blocks(m: str, most: str):
        return F.ceil(F.col(m) / F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(block_shingles) / F.col(most)))))

    wanted = members.select("node").distinct().join(classes.select("node", "doc_id", "text_hash"), "node")
    texts = rows.select("doc_id", "text_hash", "text").join(wanted, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    texts = common.materialise(texts.select("node", "text"), "minhash-texts")

    leaders = shared.groupBy("leader").agg(F.sum("m").alias("m"), F.max("most").alias("most")).select("leader", blocks("m", "most").cast("int").alias("nb"))
    leaders = common.materialise(leaders.coalesce(few), "minhash-leaders")
    own = leaders.select(F.col("leader").alias("g"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(1), F.col("nb"))).alias("j"), F.lit(0).alias("b"), F.col("leader").alias("node"))
    other = members.where("node <> leader").select("leader", "node").distinct().join(leaders, "leader")
    other = other.select(F.col("leader").alias("g"), F.lit(0).alias("i"), (F.pmod(F.xxhash64("node"), F.col("nb")) + 1).cast("int").alias("j"), "node").withColumn("b", F.col("j"))
    links = common.materialise(_confirm(own.unionByName(other).join(texts, "node"), percent), "minhash-links")
    roots = components(links, "minhash-stars")

    joined = common.materialise(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-joined")
    open_ = common.materialise(joined.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("g").coalesce(few), "minhash-open")
    if not open_.isEmpty():
        rest = common.materialise(joined.select("g", "node", "n", "leader", "root").join(open_, "g"), "minhash-rest")
        more = common.materialise(_crossed(rest, texts, percent, block, block_shingles, few), "minhash-more")
        if not more.isEmpty():
            roots = components(more.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), "minhash-roots")

    linked = classes.select("node", "doc_id", "copies").join(roots, "node", "left").where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    heads = common.materialise(linked.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("head")).coalesce(few), "minhash-heads")
    linked = linked.join(heads, "root").select(F.col("node").alias("print"), F.col("head.doc_id").alias("component"), (F.col("head.node") == F.col("node")).alias("leads"))
    out = sketch.join(linked, "print", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", *extra, "n_shingles", "component_id", kept.alias("kept"), (kept & F.coalesce("leads", F.lit(True))).alias("first"))
