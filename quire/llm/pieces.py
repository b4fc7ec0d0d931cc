"""Cutting texts into the pieces of a byte-level tokenizer with array operations, and ids kept by piece.

The pieces are those of the pattern
`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`,
found from the kinds of neighbouring characters instead of by a regex engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
POINTS = 0x110000


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point: letter, number, white space or other."""
    table = np.full(POINTS, OTHER, np.uint8)
    every = "".join(map(chr, range(POINTS)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for run in regex.finditer(pattern, every):
            table[run.start() : run.end()] = kind
    return table


@lru_cache(maxsize=1)
def _random() -> np.ndarray:
    return np.random.default_rng(20231).integers(1, 2**63, POINTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, int(n).bit_length())
    return _powers(size, BASE), _powers(size, INVERSE)


def points_of(texts: list[str]) -> tuple[np.ndarray, str]:
    """All code points, a line feed after each text, and the joined text they came from."""
    joined = "\n".join(texts) + "\n" if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), joined


def cut(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """(start, end, text number, hash) of every piece, and the joined text the offsets point into."""
    points, joined = points_of(texts)
    n = len(points)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), joined
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends_of_texts = np.cumsum(lengths + 1) - 1
    kind = table[points]
    kind[ends_of_texts] = END
    start = np.empty(n + 1, bool)
    start[0], start[n] = True, True
    start[1:n] = kind[1:] != kind[:-1]
    start[ends_of_texts] = True
    start[ends_of_texts + 1] = True
    # A run of white space before something else leaves its last character: a blank joins what follows.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[1:] != END) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    marks = np.flatnonzero((points == 39) & start[:n])
    if len(marks):
        one = points[np.minimum(marks + 1, n - 1)]
        two = points[np.minimum(marks + 2, n - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[marks[single | double] + 1] = False
        start[marks[single] + 2] = True
        start[marks[double] + 2] = False
        start[marks[double] + 3] = True
    at = np.flatnonzero(start[:n])
    until = np.append(at[1:], n)
    owner = np.cumsum(kind[at] == END)
    real = kind[at] != END
    at, until, owner = at[real], until[real], owner[real]
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_random()[points] * power[:n], out=sums[1:])
    hashes = (sums[until] - sums[at]) * inverse[at]
    return at, until, owner, hashes, joined


class Slots:
    """A hash table of 64-bit keys to int32 values with array lookups and inserts; open addressing."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        out = self.values[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            value = self.values[slot[open_]]
            out[open_] = value
            open_ = open_[(value >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        slot = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.values[slot[left]] < 0]
            self.values[slot[free]] = values[free]
            self.keys[slot[free]] = keys[free]
            lost = self.keys[slot[left]] != keys[left]
            left = left[lost]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask


class PieceIds:
    """Ids of pieces met before, by a 64-bit hash of the piece; starts afresh when `limit` pieces are held."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self._clear(limit)

    def _clear(self, room: int) -> None:
        self.slots = Slots(max(10, int(room).bit_length() + 1))
        self.first = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint16)
        self.n = self.used = 0

    def _room(self, pieces: int, ids: int) -> None:
        for name, need in (("first", self.n + pieces), ("size", self.n + pieces), ("ids", self.used + ids)):
            now = getattr(self, name)
            if need > len(now):
                setattr(self, name, np.resize(now, max(need, len(now) * 3 // 2)))

    def lookup(self, at: np.ndarray, until: np.ndarray, hashes: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) for pieces in order."""
        if self.n + len(hashes) > self.limit:
            self._clear(max(self.limit, len(hashes)))
        entry = self.slots.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            where = missing[where]
            ids, sizes = self.encode([joined[a:b] for a, b in zip(at[where].tolist(), until[where].tolist())])
            self._room(len(new), len(ids))
            begin = self.used + np.cumsum(sizes) - sizes
            self.first[self.n : self.n + len(new)] = begin
            self.size[self.n : self.n + len(new)] = sizes
            self.ids[self.used : self.used + len(ids)] = ids
            self.slots.add(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
            self.n += len(new)
            self.used += len(ids)
            entry[missing] = self.slots.find(hashes[missing])
        sizes = self.size[entry].astype(np.int64)
        total = int(sizes.sum())
        base = np.repeat(self.first[entry] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[base + np.arange(total)], sizes
