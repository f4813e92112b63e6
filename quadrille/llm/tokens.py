"""Exact, cached encoding with the public byte-pair tokenizers.

Both vocabularies cut a text into pieces by a pattern before any merge, so a piece's ids don't depend on its
neighbours. Each Python worker keeps the ids of pieces that it has met (bounded), and sends only new pieces to the
library, joined into one text, whose ids fall apart again at word ends (or word starts).

Texts of Latin-1 characters are cut as arrays of bytes, many at once, and their pieces found by 64-bit hashes in a table
of arrays: of n new pieces among m known ones about n * m / 2^64 would be mistaken, less than one in 10^12 a piece.
Other texts are split at spaces, where with few exceptions no piece holds both sides, and the units between them are
looked up in a dictionary. Units with characters for which Python's classes and the library's might differ go to the
library as they are, and so do texts that hold the string of a special token.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata

import numpy as np

from . import common

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

# Up to U+023F every class is spelt out as ranges; a unit with anything above goes to the library.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ȿ", "0-9²³¹¼½¾"
_CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
#: Characters of units that the library takes; NUL parts units that are cut together.
_ODD = re.compile("[\0\x1c-\x1fİɀ-\U0010ffff]")


def _patterns(letters: str, digits: str) -> dict[bool, re.Pattern]:
    """Pieces of the word vocabulary (True) and of the byte vocabulary (False), and NUL between units."""
    other = rf"[^\s\0{letters}{digits}]"
    return {
        True: re.compile(rf"[{letters}]+|\0|{_CONTRACTIONS}|[{digits}]|{other}+"),
        False: re.compile(rf"{_CONTRACTIONS}| ?[{letters}]+|\0| ?[{digits}]+| ?{other}+|\s+(?![^\s\0])|\s+"),
    }


_ASCII, _LATIN = _patterns("A-Za-z", "0-9"), _patterns(_L, _N)
_JOINABLE = {True: re.compile(rf"[{_L}]+"), False: re.compile(rf" [{_L}]+")}
#: A space that further white space or the end follows; there pieces depend on the whole run.
_RUN = re.compile(r" (?!\S)")
_UNITS = re.compile(r"\s*\S+|\s+")
_MARKS = frozenset(string.punctuation)
_NUL = b"\xff\xff"  # no id: ids are below 65280, so it can't arise across two of them either


_OTHER, _LETTER, _DIGIT, _WHITE, _END = range(5)
_LONG = 256  # bytes of the longest piece that is found by its hash


def _classes() -> np.ndarray:
    """Class of each Latin-1 character; NUL ends a text."""
    out = np.full(256, _OTHER, dtype=np.uint8)
    for cls, chars in ((_LETTER, rf"[{_L}]"), (_DIGIT, rf"[{_N}]"), (_WHITE, r"\s"), (_END, "\0")):
        out[[i for i in range(256) if re.fullmatch(chars, chr(i))]] = cls
    return out


class Spans:
    """Ids of pieces by the hash of their bytes, in arrays: slots of hashes, and per slot where its ids lie in a store."""

    def __init__(self, cap: int):
        rng = np.random.default_rng(17)
        self.cap = cap
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 8 + 5
        self.base, self.inverse = np.uint64(base % (1 << 64)), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.downs = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self._room(16)
        self.n = self.used = 0
        self.store = np.zeros(1 << 16, dtype=np.uint16)

    def _room(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.at, self.size = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.uint16)

    def hashes(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(raw):
            up, down = np.full(len(raw), self.base), np.full(len(raw), self.inverse)
            up[0] = down[0] = 1
            self.powers, self.downs = np.cumprod(up), np.cumprod(down)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.values.take(raw) * self.powers[: len(raw)], out=sums[1:])
        x = (sums.take(stops) - sums.take(starts)) * self.downs.take(starts) + (stops - starts).astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) | np.uint64(1)  # 0 is an empty slot

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each key, numbers of the keys that have none)."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.keys.take(slot)
        open_ = np.flatnonzero(seen != keys)
        missing = [open_[:0]]
        while len(open_):
            free = seen.take(open_) == 0 if len(seen) == len(keys) else seen == 0
            missing.append(open_[free])
            open_ = open_[~free]
            slot[open_] = (slot[open_] + 1) & mask
            seen = self.keys.take(slot[open_])
            off = seen != keys[open_]
            open_, seen = open_[off], seen[off]
        return slot, np.concatenate(missing)

    def add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """New, distinct keys; key i has ids[ends[i - 1] : ends[i]]."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old = np.flatnonzero(self.keys)
            old = self.keys[old], self.at[old], self.size[old]
            bits = self.bits
            while 2 * (self.n + len(keys)) > 1 << bits:
                bits += 1
            self._room(bits)
            self._place(*old)
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[self.used : self.used + len(ids)] = ids
        before = np.concatenate((np.zeros(1, dtype=ends.dtype), ends[:-1]))
        self._place(keys, self.used + before, ends - before)
        self.used += len(ids)
        self.n += len(keys)

    def _place(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]  # of several for a slot the last one stays
            own = self.keys[slot[todo]] == keys[todo]
            done = todo[own]
            self.at[slot[done]], self.size[slot[done]] = at[done], size[done]
            todo = todo[~own]
            slot[todo] = (slot[todo] + 1) & mask

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slots in order, where those of each end)."""
        size = self.size.take(slots).astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.at.take(slots) - (ends - size), size) + np.arange(total)
        return self.store.take(where), ends


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedEncoder:
    """Texts to little-endian unsigned 16-bit ids; `cap` bounds the units, and 8 * cap the pieces, that are kept.

    Ids are those of the library's plain call, which takes the string of a special token in a text for that token.
    """

    def __init__(self, path: str, cap: int = 120_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers
        from tokenizers import pre_tokenizers as cutters

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocab.values()) >= 0xFF00:
            raise ValueError("ids don't fit 16 bits")
        self.words = any(t.endswith("</w>") for t in vocab)
        self.edge = np.zeros(1 << 16, dtype=bool)  # ids at which a joined piece ends (or starts)
        for token, i in vocab.items():
            self.edge[i] = token.endswith("</w>") if self.words else token.startswith("Ġ")
        self.ascii, self.extended, self.joinable = _ASCII[self.words], _LATIN[self.words], _JOINABLE[self.words]
        # For pieces that are cut and normalised already: the same model without the library's own passes.
        self.joined, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.joined, self.letters):
            if self.words:
                t.normalizer = normalizers.Sequence([])
            t.model._resize_cache(0)  # pieces come once
        cutter = cutters.WhitespaceSplit() if self.words else cutters.Split(" ", "merged_with_next")
        self.joined.pre_tokenizer = cutters.Sequence([cutter, cutters.ByteLevel(add_prefix_space=False, use_regex=False)])
        # ASCII letters stand for themselves among the vocabulary's byte characters, and a space is written Ġ.
        self.letters.pre_tokenizer = cutters.WhitespaceSplit() if self.words else cutters.Split("Ġ", "merged_with_next")
        self.cap = cap
        self.marks = dict(zip(_MARKS, self.whole(list(_MARKS)))) | {"": b""}
        self.spans, self.classes = Spans(8 * cap), _classes()
        self.pieces: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # units as they are
        self.lead: dict[str, bytes] = {}  # units without the space before them

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, library, names: list[str], joined: str, prefix: str, known: dict[str, bytes]) -> None:
        """Ids of pieces that are joined into one text; `names` are their keys, less `prefix`."""
        ids = np.asarray(library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u2")
        at = np.flatnonzero(self.edge[ids])
        cuts = np.concatenate(([0], at + 1)) if self.words else np.concatenate((at, [len(ids)]))
        if len(cuts) == len(names) + 1:
            raw, cuts = ids.tobytes(), (2 * cuts).tolist()
            known.update(zip(names, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        else:
            known.update(zip(names, self.whole([prefix + n for n in names])))

    def _learn_pieces(self, new: set[str]) -> None:
        joinable = list(filter(self.joinable.fullmatch, new))
        if joinable:
            self._joined(self.joined, joinable, (" " if self.words else "").join(joinable), "", self.pieces)
        rest = list(new.difference(joinable))
        if rest:
            self.pieces.update(zip(rest, self.whole(rest)))

    def _cut(self, units: list[str]) -> list[bytes]:
        """Ids of new units, cut into pieces all at once."""
        odd = [bool(_ODD.search(u)) for u in units]
        if any(odd):
            rest = iter(self._cut([u for u, o in zip(units, odd) if not o]) if not all(odd) else ())
            hard = iter(self.whole([u for u, o in zip(units, odd) if o]))
            return [next(hard if o else rest) for o in odd]
        text = "\0".join(units)
        plain = text.isascii()
        if self.words:
            text = (text if plain else unicodedata.normalize("NFC", text)).lower()
        cut = (self.ascii if plain else self.extended).findall(text)
        known = self.pieces
        known["\0"] = _NUL
        got = list(map(known.get, cut))
        if None in got:
            self._learn_pieces({p for p, g in zip(cut, got) if g is None})
            got = list(map(known.__getitem__, cut))
        return b"".join(got).split(_NUL)

    def _learn(self, new: set[str], known: dict[str, bytes], space: str) -> None:
        """Ids of new units, which stand after `space`."""
        plain = [u for u in new if u.isascii() and u.isalpha()]
        if plain and self.words:
            self._joined(self.letters, plain, " ".join(plain).lower(), "", known)
        elif plain and space:
            self._joined(self.letters, plain, "Ġ" + "Ġ".join(plain), space, known)
        elif plain:
            known.update(zip(plain, self.whole(plain)))
        rest = list(new.difference(plain))
        if rest:
            known.update(zip(rest, self._cut([space + u for u in rest])))

    def _look_up(self, units: list[str], known: dict[str, bytes], space: str = "") -> list[bytes]:
        got = list(map(known.get, units))
        holes: list[tuple[int, str, str]] = []
        new: set[str] = set()
        marks, get, index, at = self.marks, known.get, got.index, -1
        try:
            while True:
                at = index(None, at + 1)
                unit, mark = units[at], ""
                if unit[-1] in marks and len(unit) > 1 and "İ" != unit[-2] < "ɀ" and unit[-2].isalnum():
                    unit, mark = unit[:-1], unit[-1]
                    hit = get(unit)
                    if hit is not None:
                        got[at] = hit + marks[mark]
                        continue
                new.add(unit)
                holes.append((at, unit, mark))
        except ValueError:  # no hole is left
            pass
        if new:
            self._learn(new, known, space)
            for at, unit, mark in holes:
                got[at] = known[unit] + marks[mark]
        return got

    def _starts(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of pieces in Latin-1 texts that each end in NUL, their classes)."""
        cls = self.classes.take(raw)
        start = np.empty(len(raw), dtype=bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        start |= cls == _END
        quote = np.flatnonzero(raw == 39)
        if self.words:
            start |= cls == _DIGIT
        else:
            # The last of several white characters is a piece of its own, or the space that the next piece starts with.
            white = np.flatnonzero(cls[:-1] == _WHITE)
            last = white[(cls[white + 1] != _WHITE) & (cls[white + 1] != _END)]
            start[last] = True
            start[last[raw[last] == 32] + 1] = False
        if len(quote):
            before = np.where(quote > 0, quote - 1, len(raw) - 1)
            quote = quote[(cls[before] != _OTHER) & (self.words | (raw[before] != 32))]
            one, two = raw[quote + 1], raw[np.minimum(quote + 2, len(raw) - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long_ = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            start[quote[short | long_] + 1] = False
            start[quote[short] + 2] = True
            start[quote[long_] + 3] = True
        at = np.flatnonzero(start)
        return at, cls.take(at)

    def _latin(self, raws: list[bytes]) -> list[bytes | None]:
        """Ids of Latin-1 texts; None for one with a piece that is too long for its hash."""
        spans = self.spans
        if spans.n > spans.cap:
            spans.clear()
        joined = b"\0".join(raws) + b"\0"
        raw = np.frombuffer(joined, np.uint8)
        starts, cls = self._starts(raw)
        stops = np.append(starts[1:], len(raw))
        ends = np.flatnonzero(cls == _END)  # by text: the number of its end's piece
        too_long = np.unique(np.searchsorted(ends, np.flatnonzero(stops - starts > _LONG)))
        keep = np.flatnonzero(cls < _WHITE) if self.words else np.flatnonzero(cls != _END)
        edge = np.searchsorted(keep, ends)  # by text: how many pieces are kept before its end
        starts, stops = starts.take(keep), stops.take(keep)
        keys = spans.hashes(raw, starts, stops)
        slots, missing = spans.find(keys)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            self._learn_spans(new, [joined[a:b].decode("latin-1") for a, b in zip(starts[first].tolist(), stops[first].tolist())])
            slots, missing = spans.find(keys)
        ids, after = spans.ids(slots)
        after = np.concatenate((np.zeros(1, dtype=np.int64), after))
        cuts = (2 * after[np.concatenate((np.zeros(1, dtype=np.int64), edge))]).tolist()
        out = ids.astype("<u2", copy=False).tobytes()
        got: list[bytes | None] = [out[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in too_long.tolist():
            got[i] = None
        return got

    def _learn_spans(self, keys: np.ndarray, names: list[str]) -> None:
        """Ids of new pieces; runs of ASCII letters go to the library joined."""
        if self.words:
            plain = [i for i, p in enumerate(names) if p.isascii() and p.isalpha()]
        else:
            plain = [i for i, p in enumerate(names) if p.isascii() and p[0] == " " and p[1:].isalpha()]
        chosen = [names[i] for i in plain]
        if plain:
            text = " ".join(chosen) if self.words else "".join(chosen).replace(" ", "Ġ")
            ids = np.asarray(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint16)
            at = np.flatnonzero(self.edge[ids])
            ends = at + 1 if self.words else np.append(at[1:], len(ids))
            if len(ends) == len(plain):
                self.spans.add(keys[plain], ids, ends)
            else:
                plain = []
        rest = np.setdiff1d(np.arange(len(names)), plain, assume_unique=True)
        if len(rest):
            own = [names[i] for i in rest.tolist()]
            self._learn_pieces({p for p in own if p not in self.pieces})
            got = [self.pieces[p] for p in own]
            self.spans.add(keys[rest], np.frombuffer(b"".join(got), "<u2"), np.cumsum([len(g) // 2 for g in got]))
            if len(self.pieces) > self.cap:
                self.pieces.clear()

    def encode(self, texts: list[str], step: int = 500_000) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < step):
                size += len(texts[end])
                end += 1
            out.extend(self._step(texts[at:end]))
            at = end
        return out

    def _step(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        own, raws = [], []
        for i, t in enumerate(texts):
            try:
                raw = t.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if "\0" in t or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t or any(s in t for s in self.specials):
                continue
            own.append(i)
            raws.append(t.lower().encode("latin-1") if self.words else raw)
        if own:
            for i, x in zip(own, self._latin(raws)):
                out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self._some([texts[i] for i in rest])):
                out[i] = x
        return out

    def _units(self, text: str) -> tuple[list[str], list[str]]:
        """(units as they are, then units that follow a space)."""
        if not self.words:
            if _RUN.search(text):
                return _UNITS.findall(text), []
            units = text.split(" ")
            return units[:1] if units[0] else [], units[1:]
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to Python alone
            return [u for u in text.split(" ") if u], []
        if text.isascii():
            return text.lower().split(), []
        return text.split(), []

    def _some(self, texts: list[str]) -> list[bytes]:
        for known in (self.pieces, self.bare, self.lead):
            if len(known) > self.cap:
                known.clear()
        bare: list[str] = []
        lead: list[str] = []
        ends: list[tuple[int, int]] = [(0, 0)]
        special = [any(s in t for s in self.specials) for t in texts]
        for t, s in zip(texts, special):
            if not s:
                a, b = self._units(t)
                bare += a
                lead += b
            ends.append((len(bare), len(lead)))
        first, rest = self._look_up(bare, self.bare), self._look_up(lead, self.lead, " ")
        whole = iter(self.whole([t for t, s in zip(texts, special) if s]) if any(special) else ())
        return [next(whole) if s else b"".join(first[a:c]) + b"".join(rest[b:d]) for s, (a, b), (c, d) in zip(special, ends, ends[1:])]


def encoder(path: str) -> CachedEncoder:
    """One per Python worker and vocabulary."""
    return common.worker_cache(path, lambda: CachedEncoder(path))
