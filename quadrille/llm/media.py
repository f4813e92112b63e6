"""Telephony audio in a column.

Mu-law and A-law samples expand by tables of 256 entries, IMA ADPCM decodes step by step inside a block but for all
blocks at once, and PCM is resampled by a windowed-sinc filter. The stored form is a WAV file whose 8-bit samples are
the payload itself, so it reads back without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MULAW, ALAW, IMA_ADPCM = 7, 6, 17
RATE = 8000


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits give a sign, a 3-bit exponent and a 4-bit mantissa, biased by 132."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits are inverted; exponent 0 is linear."""
    a = np.arange(256) ^ 0x55
    exponent, mantissa = a >> 4 & 7, (a & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


#: Fixed values of IMA ADPCM: the 89 step sizes and what a code adds to the step's index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
    230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749,
    3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)

_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def expand(samples: np.ndarray, law: int) -> np.ndarray:
    return _TABLES[law][samples]


def _adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next index for every (index, code), so that a step is two lookups."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (np.clip(np.arange(89)[:, None] + MOVES[code & 7], 0, 88) * 16).astype(np.int32).ravel()


_DIFFERENCE, _NEXT = _adpcm_moves()


def decode_adpcm(raw: bytes | np.ndarray, block: int = 64) -> np.ndarray:
    """Mono IMA ADPCM in blocks of `block` bytes: a header (first sample, index, reserved), then two codes a byte.

    Samples of a block depend on each other, blocks don't: one step handles the same code of all blocks. An index out
    of range is taken for the nearest sound one. Returns an array of blocks x samples.
    """
    blocks = np.frombuffer(raw, np.uint8).reshape(-1, block)
    now = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out = np.empty((2 * (block - 4) + 1, len(blocks)), dtype=np.int16)
    out[0] = now
    at = 1
    for byte in np.ascontiguousarray(blocks[:, 4:].T):
        for code in (byte & 15, byte >> 4):
            cell = index + code
            now = np.minimum(np.maximum(now + _DIFFERENCE[cell], -32768), 32767)
            index = _NEXT[cell]
            out[at] = now
            at += 1
    return out.T


def resample(pcm: np.ndarray, source: int, target: int, taps: int = 15) -> np.ndarray:
    """PCM at another rate: below the source rate behind a windowed-sinc low-pass, then linear interpolation."""
    if source == target or not len(pcm):
        return pcm
    x = pcm.astype(np.float32)
    if target < source:
        cells = max(taps, int(taps * source / target) | 1)
        t = (np.arange(cells) - cells // 2) * target / source
        h = np.sinc(t) * np.hamming(cells)
        x = np.convolve(x, (h / h.sum()).astype(np.float32))[cells // 2 : cells // 2 + len(pcm)]
    at = np.arange(-(-len(pcm) * target // source)) * np.float32(source / target)
    low = np.minimum(at.astype(np.int64), len(x) - 1)
    high = np.minimum(low + 1, len(x) - 1)
    return np.clip(np.rint(x[low] + (x[high] - x[low]) * (at - low)), -32768, 32767).astype(np.int16)


def wav(payload: bytes, law: int = MULAW, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit samples; the fact chunk counts them."""
    fmt = struct.pack("<HHIIHHH", law, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(raw: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, block size, data) of a WAV file; chunks may stand in any order."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, law, rate, block, data = 12, 0, 0, 1, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            law, _, rate, _, block = struct.unpack_from("<HHIIH", raw, at + 8)
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return law, rate, block, data


def to_pcm(raw: bytes, target: int = 16000) -> np.ndarray:
    """Resampled PCM of a telephony WAV file in any of the three forms."""
    law, rate, block, data = read_wav(raw)
    if law == IMA_ADPCM:
        pcm = decode_adpcm(data[: len(data) // block * block], block).reshape(-1)
    else:
        pcm = expand(np.frombuffer(data, np.uint8), law)
    return resample(pcm, rate, target)


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """What linear interpolation puts between neighbours of `even`, halves to even: `n` values, the last one as it is."""
    total = even.astype(np.int32)
    total += np.append(total[1:], total[-1:])
    low = total >> 1
    return (low + (total & low & 1))[:n].astype(np.int16)


def pack(pcm: np.ndarray) -> bytes:
    """16-bit samples without loss, so that they compress well: every other one, then how the rest differ from a line
    between their neighbours, which is nothing where the rate was doubled."""
    even, odd = pcm[0::2], pcm[1::2]
    return even.astype("<i2").tobytes() + (odd - _between(even, len(odd))).astype("<i2").tobytes()


def unpack(raw: bytes) -> bytes:
    """Little-endian samples that pack() has packed."""
    x = np.frombuffer(raw, "<i2")
    out = np.empty(len(x), "<i2")
    half = -(-len(x) // 2)
    out[0::2] = x[:half]
    out[1::2] = x[half:] + _between(x[:half], len(x) - half)
    return out.tobytes()


def store_packed(docs: DataFrame, unit: int = 64, target: int = 16000) -> DataFrame:
    """docs(doc_id, text) as stored media: doc_id, n_bytes, media (a mu-law WAV file of the padded text) and packed (its sound
    as 16-bit samples at `target` Hz, packed without loss), written and read back.

    A null text is an empty one; the payload is never empty, as zero bytes fill it to a positive multiple of `unit`. Rows
    that repeat a doc_id are stored each.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 128):
            raws = [t.encode("utf-8", "surrogatepass") for t in common.strings(b.column("text"))]
            media = [wav(r + b"\0" * (max(unit, -(-len(r) // unit) * unit) - len(r))) for r in raws]
            pcm = [pack(to_pcm(m, target)) for m in media]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], ["doc_id", "n_bytes", "media", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, packed binary")
    return common.materialise(rows, "media", "zstd", 9)


def store_text(docs: DataFrame, unit: int = 64, target: int = 16000) -> DataFrame:
    """What store_packed() stores, read back, with pcm in place of packed: its little-endian 16-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 128):
            pcm = [unpack(x) for x in b.column("packed").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), b.column("media"), pa.array(pcm, pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])

    return store_packed(docs, unit, target).mapInArrow(run, "doc_id long, n_bytes long, media binary, pcm binary")


def features(media: DataFrame, block: int = 64) -> DataFrame:
    """Per row of media(doc_id, n_bytes, media, and pcm or packed): digests of what is stored and a feature string of its sound.

    The string has peak and root mean square of the mu-law and A-law readings, zero crossings of the first, number and
    checksum of the stored PCM's samples, and peak and checksum of the payload's blocks read as ADPCM.
    """
    common.ship(media.sparkSession)
    sound = "packed" if "packed" in media.columns else "pcm"
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]

    def adpcm(payloads: list[bytes]) -> Iterator[tuple[int, int]]:
        """(peak, checksum) of each payload; blocks of many rows decode together, a few MB at a time."""
        group: list[bytes] = []
        for i, p in enumerate(payloads):
            group.append(p)
            if sum(map(len, group)) > 1 << 20 or i + 1 == len(payloads):
                decoded, at = decode_adpcm(b"".join(group), block), 0
                for x in group:
                    own = decoded[at : at + len(x) // block]
                    yield int(np.abs(own.astype(np.int32)).max()), zlib.crc32(np.ascontiguousarray(own))
                    at += len(x) // block
                group = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        energy = {law: (t.astype(np.float64) ** 2, np.abs(t.astype(np.int64))) for law, t in _TABLES.items()}
        for b in common.slices(batches, 128):
            media = b.column("media").to_pylist()
            payloads = [read_wav(m)[3] for m in media]
            out = []
            for n, m, p, low, (peak, crc) in zip(b.column("n_bytes").to_pylist(), media, payloads, b.column(sound).to_pylist(), adpcm(payloads)):
                if sound == "packed":
                    low = unpack(low)
                samples = np.frombuffer(p, np.uint8)
                seen = np.bincount(samples, minlength=256)
                loud = [(int(size[seen > 0].max()), int(round(float((seen @ square) / len(samples)) ** 0.5))) for square, size in (energy[MULAW], energy[ALAW])]
                pcm = expand(samples, MULAW)
                crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
                feature = f"mulaw:{loud[0][0]},{loud[0][1]},{crossings};alaw:{loud[1][0]},{loud[1][1]};pcm:{len(low) // 2},{zlib.crc32(low)};adpcm:{peak},{crc}"
                out.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds[1:])] if out else [pa.array([], t) for t in kinds[1:]]
            yield pa.record_batch([b.column("doc_id"), *columns], [c.split()[0] for c in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media", sound).mapInArrow(run, schema)


def pcm_column(media: DataFrame, target: int = 16000) -> DataFrame:
    """media(doc_id, media) of WAV files in any of the three forms, with pcm: the sound as little-endian 16-bit samples at
    `target` Hz; null for null media."""
    common.ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            pcm = [None if m is None else to_pcm(m, target).astype("<i2").tobytes() for m in b.column("media").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(pcm, pa.binary())], ["doc_id", "pcm"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, pcm binary")
