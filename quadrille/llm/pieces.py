"""SentencePiece encoding and decoding, giant documents in parallel chunks.

Where a model's scores add up (unigram models), the best segmentation of a text is a shortest-path problem whose steps
are at most as long as the longest piece. A giant document is cut into chunks at any character. What happens at a cut
is told by one number, how far the piece in progress reaches past it, so a chunk is a small matrix of best scores from
entry to exit state. Matrices are combined by the max-plus product, which is associative; states at all cuts follow,
and every chunk is backtraced on its own.

The scores of a BPE model are the negated ranks of its merges and don't add up, so its texts get the merges themselves
(`Merges`), by the library and word by word. A giant document is cut only where no piece can hold both sides: merges
never reach across.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Spans, vocabulary_path

MODEL = "piece_bpe_32k.model"
_LOW = -np.inf
_WORDS, _EDGE = re.compile(" +[^ ]*"), re.compile("[^ ] ")
_RUNS = re.compile(" +[^ ]*|[^ ]+")  # a chunk may begin inside a word
_DIGEST = "doc_id string, n_tokens long, ids_crc32 long, score double, n_chunks long, round_trip boolean"


class Pieces:
    """Pieces, scores and byte ids of a model; texts have a space before them, and a space after a word starts a new one."""

    def __init__(self, path: str, cap: int = 500_000):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bytes_ = np.zeros(256, dtype=np.int64)
        self.known: dict[str, tuple[int, float]] = {}
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes_[int(piece[3:-1], 16)] = i
                self.raw[i] = bytes([int(piece[3:-1], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                text = piece.replace("▁", " ")
                self.raw[i] = text.encode()
                self.known[text] = (i, m.get_score(i))
        if any(" " in p.lstrip(" ") for p in self.known):
            raise ValueError("a piece holds a space after another character")
        self.longest = max(map(len, self.known))
        self.size = np.array([len(r) for r in self.raw])
        self.flat, self.at = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(self.size) - self.size
        #: Neighbouring characters that some piece holds; between any others a cut is certain.
        self.pairs = {p[i : i + 2] for p in self.known for i in range(len(p) - 1)}
        #: Beginnings of pieces: a search ends where it leaves them.
        self.starts: dict[str, tuple[int, float] | None] = {p[:i]: None for p in self.known for i in range(1, len(p))}
        self.starts.update(self.known)
        self.missing = min(s for _, s in self.known.values() if s > -1e8) - 10.0  # runs of spaces score -1e9
        self.cap, self.words, self.cores = cap, {}, {}

    def steps(self, text: str, start: int, end: int, limit: int) -> Iterator[tuple[int, float, tuple[int, ...] | int]]:
        """(end, score, id or byte ids) of the pieces that start at `start`; they end by `limit`."""
        known, found = self.known, False
        for stop in range(start + 1, min(start + self.longest, limit) + 1):
            hit = known.get(text[start:stop])
            if hit is not None:
                found = found or stop == start + 1
                yield stop, hit[1], hit[0]
            elif stop == start + 1:
                yield stop, self.missing, tuple(self.bytes_[list(text[start].encode("utf-8", "surrogatepass"))].tolist())

    def best(self, text: str, start: int, end: int, stop: int) -> tuple[float, list[int]]:
        """Score and ids of the best pieces that cover text[start:stop] and each start before `end`; ties to the longer
        last piece."""
        if start >= stop:
            return (0.0, []) if start == stop else (_LOW, [])
        score, back = [_LOW] * (stop - start + 1), [None] * (stop - start + 1)
        score[0] = 0.0
        for at in range(start, min(end, stop)):
            base = score[at - start]
            if base == _LOW:
                continue
            for to, gain, ids in self.steps(text, at, end, stop):
                if base + gain > score[to - start]:
                    score[to - start], back[to - start] = base + gain, (at, ids)
        if score[-1] == _LOW:
            return _LOW, []
        ids: list = []
        at = stop
        while at > start:
            at, own = back[at - start]
            ids.extend(reversed(own) if isinstance(own, tuple) else (own,))
        return score[-1], ids[::-1]

    def core(self, w: str) -> tuple[bytes, float]:
        """Ids and score of a run of characters without a certain cut: best() without its limits."""
        n, starts = len(w), self.starts
        score, back = [0.0] + [_LOW] * n, [None] * (n + 1)
        for at in range(n):
            base = score[at]
            if base == _LOW:
                continue
            alone = False
            for to in range(at + 1, n + 1):
                hit = starts.get(w[at:to], 0)
                if hit == 0:
                    break
                if hit is not None:
                    alone = alone or to == at + 1
                    if base + hit[1] > score[to]:
                        score[to], back[to] = base + hit[1], (at, hit[0])
            if not alone and base + self.missing > score[at + 1]:
                score[at + 1], back[at + 1] = base + self.missing, (at, tuple(self.bytes_[list(w[at].encode("utf-8", "surrogatepass"))].tolist()))
        ids: list = []
        at = n
        while at:
            at, own = back[at]
            ids.extend(reversed(own) if isinstance(own, tuple) else (own,))
        return np.asarray(ids[::-1], dtype="<u2").tobytes(), score[n]

    def word(self, w: str) -> tuple[bytes, float]:
        """Ids (as bytes) and score of spaces and what follows them to the next."""
        if len(self.words) > self.cap:
            self.words.clear()
        if len(self.cores) > self.cap:
            self.cores.clear()
        pairs, cores, raw, total, at = self.pairs, self.cores, b"", 0.0, 0
        for i in range(1, len(w) + 1):
            if i == len(w) or w[i - 1 : i + 1] not in pairs:
                part = w[at:i]
                hit = cores.get(part)
                if hit is None:
                    hit = cores[part] = self.core(part)
                raw, total, at = raw + hit[0], total + hit[1], i
        hit = self.words[w] = (raw, total)
        return hit

    def whole(self, text: str) -> tuple[bytes, float]:
        """Ids and score, in one go, of a text that starts with a space: its words never share a piece."""
        get, word = self.words.get, self.word
        hits = [get(w) or word(w) for w in _WORDS.findall(text)]
        return b"".join([h[0] for h in hits]), sum([h[1] for h in hits])

    @staticmethod
    def edges(text: str, size: int) -> tuple[int, int]:
        """First and last word start inside a chunk (a space after another character); -1, -1 where there is none."""
        hit = _EDGE.search(text, 0, size)
        if hit is None:
            return -1, -1
        last = text.rfind(" ", 1, size)
        while text[last - 1] == " ":
            last -= 1
        return hit.start() + 1, last

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes, without the space before it."""
        return self.spelt(ids)[1:]

    def spelt(self, ids: np.ndarray) -> bytes:
        size = self.size.take(ids)
        ends = np.cumsum(size)
        where = np.repeat(self.at.take(ids) - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat.take(where).tobytes()

    # chunks: text[:size] is the chunk's own, what follows is look-ahead

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Best score from each entry state (characters already covered) to each exit state (characters past the chunk)."""
        s = self.longest
        m = np.full((s, s), _LOW)
        for i in range(size, s):
            m[i, i - size] = 0.0  # a piece that spans the whole chunk
        first, last = self.edges(text, size)
        exits = range(0, min(s, len(text) - size + 1))
        if first > 0:
            middle = self.whole(text[first:last])[1] if last > first else 0.0
            left = [self.best(text, i, first, first)[0] if i <= first else _LOW for i in range(min(s, size))]
            right = [self.best(text, last, size, size + j)[0] for j in exits]
            for i, a in enumerate(left):
                m[i, : len(right)] = a + middle + np.array(right)
        else:
            for i in range(min(s, size)):
                for j in exits:
                    m[i, j] = self.best(text, i, size, size + j)[0]
        return m

    def trace(self, text: str, size: int, entry: int, exit_: int) -> bytes:
        """Ids of the pieces that start in the chunk, given the states at both ends."""
        first, last = self.edges(text, size)
        if entry >= size:
            return b""
        if first < 0:
            return np.asarray(self.best(text, entry, size, size + exit_)[1], dtype="<u2").tobytes()
        middle = self.whole(text[first:last])[0] if last > first else b""
        ends = [self.best(text, entry, first, first)[1], self.best(text, last, size, size + exit_)[1]]
        return np.asarray(ends[0], dtype="<u2").tobytes() + middle + np.asarray(ends[1], dtype="<u2").tobytes()


class Merges:
    """The library's own ids of a BPE model, of runs of characters that no piece leaves; words are encoded once and kept, found
    by 64-bit hashes of their bytes."""

    def __init__(self, path: str, cap: int = 80_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.bpe = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        #: Whether texts are taken as they are, so that runs can be encoded apart.
        self.plain = not (spec.precompiled_charsmap or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix) and spec.add_dummy_prefix and spec.escape_whitespaces
        spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.scores = np.array([p.score for p in proto.pieces])
        pieces = [p.piece.replace("\u2581", " ") for p in proto.pieces]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.cap, self.cores, self.spans = cap, {}, Spans(8 * cap)

    @staticmethod
    def text(text: str) -> str:
        """What the model sees: a space before a text that isn't empty; U+2581 is a space to it."""
        return " " + text.replace("\u2581", " ") if text else ""

    def word(self, w: str) -> bytes:
        if len(self.cores) > self.cap:
            self.cores.clear()
        pairs, cores, raw, at = self.pairs, self.cores, [], 0
        for i in range(1, len(w) + 1):
            if i == len(w) or w[i - 1 : i + 1] not in pairs:
                part = w[at:i]
                hit = cores.get(part)
                if hit is None:
                    hit = cores[part] = np.asarray(self.model.encode(part), dtype="<u2").tobytes()
                raw.append(hit)
                at = i
        return b"".join(raw)

    def whole(self, text: str) -> bytes:
        """Ids of a text as text() gives it, or of a chunk of one."""
        return b"".join(map(self.word, _RUNS.findall(text)))

    def many(self, texts: list[str], step: int = 500_000) -> list[bytes]:
        """whole() of each."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < step):
                size += len(texts[end])
                end += 1
            own = [i for i in range(at, end) if "\0" not in texts[i]]
            found = dict(zip(own, self._many([texts[i].encode("utf-8", "surrogatepass") for i in own]) if own else ()))
            out.extend(self.whole(texts[i]) if found.get(i) is None else found[i] for i in range(at, end))
            at = end
        return out

    def _many(self, raws: list[bytes], longest: int = 256) -> list[bytes | None]:
        """Ids of texts without NUL, from their words' hashes; None for one with a word too long for that."""
        spans = self.spans
        if spans.n > spans.cap:
            spans.clear()
        joined = b"\0".join(raws) + b"\0"
        raw = np.frombuffer(joined, np.uint8)
        space = raw == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        ends = np.flatnonzero(raw == 0)
        start[0] = True
        start[ends] = True
        start[ends[:-1] + 1] = True
        starts = np.flatnonzero(start)
        stops = np.append(starts[1:], len(raw))
        keep = np.flatnonzero(raw.take(starts) != 0)
        starts, stops = starts.take(keep), stops.take(keep)
        keys = spans.hashes(raw, starts, stops)
        slots, missing = spans.find(keys)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            got = [self.word(joined[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(starts[first].tolist(), stops[first].tolist())]
            spans.add(new, np.frombuffer(b"".join(got), "<u2"), np.cumsum([len(g) // 2 for g in got]))
            slots, missing = spans.find(keys)
        ids, after = spans.ids(slots)
        after = np.concatenate((np.zeros(1, dtype=np.int64), after))
        cuts = (2 * after[np.concatenate((np.zeros(1, dtype=np.int64), np.searchsorted(starts, ends)))]).tolist()
        out = ids.astype("<u2", copy=False).tobytes()
        found: list[bytes | None] = [out[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.unique(np.searchsorted(ends, starts[stops - starts > longest])).tolist():
            found[i] = None
        return found

    def cuts(self, text: str, chunk: int) -> list[int]:
        """Ends of chunks: the first place at `chunk` characters or later where no piece holds both sides."""
        ends, at, pairs = [], chunk, self.pairs
        while at < len(text):
            if text[at - 1 : at + 1] not in pairs:
                ends.append(at)
                at += chunk
            else:
                at += 1
        return [*ends, len(text)]


def both(path: str) -> tuple[Merges, Pieces]:
    """One of each per Python worker and model."""
    return common.worker_cache(path + " merges", lambda: (Merges(path), Pieces(path)))


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def product(matrices: np.ndarray) -> np.ndarray:
    """The max-plus product of matrices in order, by halves."""
    while len(matrices) > 1:
        half = maxplus(matrices[0 : len(matrices) // 2 * 2 : 2], matrices[1::2])
        matrices = np.concatenate((half, matrices[-1:])) if len(matrices) % 2 else half
    return matrices[0]


def states(matrices: np.ndarray, entry: int = 0, exit_: int = 0) -> np.ndarray:
    """State at every cut of a run of chunks, `entry` at its start and `exit_` at its end included, from their matrices."""
    reach = [np.full(matrices.shape[1], _LOW)]
    reach[0][entry] = 0.0
    for m in matrices:
        reach.append((reach[-1][:, None] + m).max(axis=0))
    out = np.zeros(len(matrices) + 1, dtype=np.int64)
    out[0], out[-1] = entry, exit_
    for k in range(len(matrices) - 1, 0, -1):
        out[k] = int((reach[k] + matrices[k][:, out[k + 1]]).argmax())
    return out


def model(path: str) -> Pieces:
    """One per Python worker and model."""
    return common.worker_cache(path, lambda: Pieces(path))


def encode(docs: DataFrame, path: str | None = None, chunk: int = 32_768, with_ids: bool = False, block: int = 64) -> DataFrame:
    """docs(doc_id, text): doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), score, n_chunks, round_trip (and ids).

    Ids are those of the library. Of a BPE model they are its merges and the score is the sum of their ranks, else the
    segmentation of greatest score by the scan. A null text is an empty one, without ids (a lone space to the scan). Texts above
    `chunk` characters are cut into chunks, others are one chunk. The scan combines the matrices of `block` chunks in a task,
    then those of a document's blocks, and goes back into every block on its own. round_trip tells whether the ids decode to the text; it is false only for texts that hold U+2581 themselves.
    Rows that repeat a doc_id are encoded each.
    """
    spark = docs.sparkSession
    common.ship(spark)
    path = path or vocabulary_path(MODEL)
    digest = _DIGEST + (", ids binary" if with_ids else "")
    own = Merges(path)
    if own.bpe:
        if not own.plain:
            raise ValueError("a model that changes texts before its merges")
        return _encode_merges(docs, path, chunk, with_ids)
    import pandas as pd

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        columns = ["row", "doc_id", "n_tokens", "ids_crc32", "score", "n_chunks", "round_trip", "ids", "chunk", "size", "piece", "matrix"]
        for b in batches:
            out = []
            for row, doc_id, text in zip(b["row"], b["doc_id"], b["text"]):
                if len(text) <= chunk:
                    raw, score = m.whole(" " + text)
                    ids = np.frombuffer(raw, "<u2")
                    sound = m.decode(ids) == text.encode("utf-8", "surrogatepass")
                    out.append((row, doc_id, len(ids), zlib.crc32(ids.astype("<u4")), score, 1, sound, raw if with_ids else None, None, None, None, None))
                    continue
                text = " " + text
                count = -(-len(text) // chunk)
                for k in range(count):
                    part = text[k * chunk : (k + 1) * chunk + m.longest - 1]
                    size = min(chunk, len(text) - k * chunk)
                    out.append((row, doc_id, None, None, None, count, None, None, k, size, part, None))
                    if len(out) >= 256:
                        yield pd.DataFrame(out, columns=columns).drop(columns="matrix")
                        out = []
            if out:
                yield pd.DataFrame(out, columns=columns).drop(columns="matrix")

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = common.materialise(texts.mapInPandas(first, "row long, doc_id string, n_tokens long, ids_crc32 long, score double, n_chunks long, round_trip boolean, ids binary, chunk long, size long, piece string"), "pieces-first")
    small = rows.where("chunk IS NULL").select("doc_id", "n_tokens", "ids_crc32", "score", "n_chunks", "round_trip", *["ids"] * with_ids)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "chunk": b["chunk"], "matrix": [m.transfer(p, s).astype("<f8").tobytes() for p, s in zip(b["piece"], b["size"])]})

    n = common.parallelism(spark)
    large = rows.where("chunk IS NOT NULL")
    spread = large.select("row", "doc_id", "chunk", "n_chunks", "size", "piece").repartition(n, "row", "chunk")

    def stack(column) -> np.ndarray:
        side = int((len(column.iloc[0]) // 8) ** 0.5)
        return np.stack([np.frombuffer(x, "<f8").reshape(side, side) for x in column])

    def combine(g: pd.DataFrame) -> pd.DataFrame:
        """The product of a block's matrices."""
        g = g.sort_values("chunk")
        return pd.DataFrame({"row": g["row"].iloc[:1], "block": g["block"].iloc[:1], "matrix": [product(stack(g["matrix"])).astype("<f8").tobytes()]})

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        """States at the ends of a document's blocks."""
        g = g.sort_values("block")
        at = states(stack(g["matrix"]))
        return pd.DataFrame({"row": g["row"], "block": g["block"], "enter": at[:-1], "leave": at[1:]})

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        """States at the cuts within a block, given those at its ends."""
        g = g.sort_values("chunk")
        m = stack(g["matrix"])
        at = states(m, int(g["enter"].iloc[0]), int(g["leave"].iloc[0]))
        score = [float(m[k, at[k], at[k + 1]]) for k in range(len(m))]
        return pd.DataFrame({"row": g["row"], "chunk": g["chunk"], "entry": at[:-1], "exit": at[1:], "part_score": score})

    cells = spread.select("row", "chunk", "size", "piece").mapInPandas(matrices, "row long, chunk long, matrix binary")
    cells = common.materialise(cells.withColumn("block", F.floor(F.col("chunk") / block).cast("long")), "pieces-matrices")
    ends = cells.groupBy("row", "block").applyInPandas(combine, "row long, block long, matrix binary").groupBy("row").applyInPandas(scan, "row long, block long, enter long, leave long")
    cuts = cells.join(ends, ["row", "block"]).groupBy("row", "block").applyInPandas(inside, "row long, chunk long, entry long, exit long, part_score double")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            ids = [m.trace(p, s, e, x) for p, s, e, x in zip(b["piece"], b["size"], b["entry"], b["exit"])]
            yield b[["row", "doc_id", "chunk", "n_chunks", "part_score"]].assign(ids=ids, own=[p[: s] for p, s in zip(b["piece"], b["size"])])

    traced = spread.join(cuts, ["row", "chunk"]).mapInPandas(trace, "row long, doc_id string, chunk long, n_chunks long, part_score double, ids binary, own string")

    def join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks of a document arrive in order; sums and checksums run on, so only with_ids holds a document whole."""
        m = model(path)
        now, state = None, None
        columns = [c.split()[0] for c in digest.split(", ")]

        def done(s):
            sound = s["left"] == b"" and s["sound"]
            return pd.DataFrame([(s["doc_id"], s["n"], s["crc"], s["score"], s["chunks"], sound, *[b"".join(s["ids"])] * with_ids)], columns=columns)

        for b in batches:
            for row, doc_id, chunks, score, raw, own in zip(b["row"], b["doc_id"], b["n_chunks"], b["part_score"], b["ids"], b["own"]):
                if row != now:
                    if state is not None:
                        yield done(state)
                    now, state = row, {"doc_id": doc_id, "n": 0, "crc": 0, "score": 0.0, "chunks": chunks, "sound": True, "left": b"", "ids": []}
                ids = np.frombuffer(raw, "<u2")
                state["n"] += len(ids)
                state["crc"] = zlib.crc32(ids.astype("<u4"), state["crc"])
                state["score"] += score
                if with_ids:
                    state["ids"].append(raw)
                # the decoded bytes may run past the chunk or fall short of it by what the last piece covers
                decoded = b"".join([m.raw[i] for i in ids.tolist()])
                want = own.encode("utf-8", "surrogatepass")
                left = state["left"]
                if isinstance(left, tuple):
                    want, left = want[len(left[0]) :] if want.startswith(left[0]) else b"\0mismatch", b""
                state["sound"] &= decoded.startswith(want) or want.startswith(decoded)
                over = decoded[len(want) :]
                state["left"] = (over,) if over else b""
        if state is not None:
            yield done(state)

    large_rows = traced.repartition(n, "row").sortWithinPartitions("row", "chunk").mapInPandas(join_up, digest)
    return small.unionByName(common.materialise(large_rows, "pieces-large")).withColumn("doc_id", F.col("doc_id").cast("long"))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [()] * len(schema.split(", "))
    fields = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _encode_merges(docs: DataFrame, path: str, chunk: int, with_ids: bool) -> DataFrame:
    """encode() of a BPE model: chunks of giant documents are encoded apart, then put in order by row."""
    spark = docs.sparkSession
    cut_schema = f"row long, {_DIGEST}, ids binary, chunk long, piece string"
    part_schema = "row long, doc_id string, n_chunks long, round_trip boolean, chunk long, ids binary, score double"
    digest = _DIGEST + (", ids binary" if with_ids else "")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, plain = both(path)
        for b in common.slices(batches, 256):
            out, texts = [], b.column("text").to_pylist()
            raws = iter(m.many([m.text(t) for t in texts if len(t) <= chunk]))
            for row, doc_id, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), texts):
                if len(text) <= chunk:
                    raw = next(raws)
                    ids = np.frombuffer(raw, "<u2")
                    sound = plain.decode(ids) == text.encode("utf-8", "surrogatepass")
                    out.append((row, doc_id, len(ids), zlib.crc32(ids.astype("<u4")), float(m.scores[ids].sum()), 1, sound, raw if with_ids else None, None, None))
                    continue
                seen = m.text(text)
                ends = m.cuts(seen, chunk)
                for k, (at, end) in enumerate(zip([0, *ends], ends)):
                    out.append((row, doc_id, None, None, None, len(ends), "\u2581" not in text, None, k, seen[at:end]))
                    if len(out) >= 256:
                        yield _rows(out, cut_schema)
                        out = []
            if out:
                yield _rows(out, cut_schema)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = common.materialise(texts.mapInArrow(first, cut_schema), "pieces-first")
    small = rows.where("chunk IS NULL").select(*[c.split()[0] for c in _DIGEST.split(", ")], *["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, plain = both(path)
        for b in common.slices(batches, 64):
            pieces = b.column("piece").to_pylist()
            ids = [np.frombuffer(r, "<u2") for r in m.many(pieces)]
            sound = [ok and plain.spelt(x) == p.encode("utf-8", "surrogatepass") for ok, x, p in zip(b.column("round_trip").to_pylist(), ids, pieces)]
            own = [b.column(c).to_pylist() for c in ("row", "doc_id", "n_chunks")]
            yield _rows(list(zip(*own, sound, b.column("chunk").to_pylist(), [x.tobytes() for x in ids], [float(m.scores[x].sum()) for x in ids])), part_schema)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of a document arrive in order; sums and checksums run on, so only with_ids holds a document whole."""
        now, state = None, None
        done = lambda s: _rows([(*s[:6], *[b"".join(s[6])] * with_ids)], digest)
        for b in common.slices(batches, 64):
            for row, doc_id, chunks, score, raw, sound in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "n_chunks", "score", "ids", "round_trip"))):
                if row != now:
                    if state is not None:
                        yield done(state)
                    now, state = row, [doc_id, 0, 0, 0.0, chunks, True, []]
                ids = np.frombuffer(raw, "<u2")
                state[1] += len(ids)
                state[2] = zlib.crc32(ids.astype("<u4"), state[2])
                state[3] += score
                state[5] &= bool(sound)
                if with_ids:
                    state[6].append(raw)
        if state is not None:
            yield done(state)

    n = common.parallelism(spark)
    large = rows.where("chunk IS NOT NULL").select("row", "doc_id", "n_chunks", "round_trip", "chunk", "piece").repartition(n, "row", "chunk")
    encoded = large.mapInArrow(run, part_schema)
    large_rows = encoded.repartition(n, "row").sortWithinPartitions("row", "chunk").mapInArrow(join_up, digest)
    return small.unionByName(common.materialise(large_rows, "pieces-large")).withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows(doc_id, ids binary of little-endian 16-bit ids): doc_id, text; null ids give a null text, and bytes that
    aren't UTF-8 become U+FFFD."""
    common.ship(rows.sparkSession)
    path = path or vocabulary_path(MODEL)
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if x is None else m.decode(np.frombuffer(x, "<u2")).decode("utf-8", "replace") for x in b["ids"]]})

    return rows.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "ids").mapInPandas(run, "doc_id string, text string").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
