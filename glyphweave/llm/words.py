"""Words of many texts at once, as numpy arrays.

Texts are lower-cased (A-Z), split on the six ASCII blanks and laid out in one
byte buffer: five line feeds, the words joined by spaces, one line feed. Words
are hashed by a polynomial over random byte values, from prefix sums modulo
2**64, and mixed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np

PAD = 5
BLOCK = 1_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, up to n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + BLOCK // 4)
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (MULTIPLIER, inverse)]
    return _powers[0], _powers[1]


def blocks(texts: Iterable[str | None], lower: bool = True, table: bytes | None = None, closing: bytes = b"") -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first text, number of texts, buffer, where each text's words begin).

    ``table`` translates bytes before the split; ``closing`` follows the last word."""
    first, parts, size, starts = 0, [b"\n"], 1, []
    n = 0
    for text in texts:
        raw = (text or "").encode()
        raw = raw.lower() if lower else raw
        words = b" ".join((raw.translate(table) if table else raw).split())
        words += closing if words else b""
        starts.append(size + PAD)
        parts.append(b"\n" * PAD + words + b"\n")
        size += PAD + len(words) + 1
        n += 1
        if size >= BLOCK:
            yield first, n, b"".join(parts), np.array(starts, np.int64)
            first, n, parts, size, starts = first + n, 0, [b"\n"], 1, []
    if n:
        yield first, n, b"".join(parts), np.array(starts, np.int64)


def hashed_words(buffer: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and how many words each text has."""
    value, _, _, per_text = hashed_spans(buffer, starts)
    return value, per_text


def hashed_spans(buffer: bytes, starts: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash, begin and end of every word, how many words each text has, then
    for each of ``prefixes`` the hash of that many first bytes (of the whole
    word where it is shorter)."""
    data = np.frombuffer(buffer, np.uint8)
    blank = data <= 32
    blank &= (data == 32) | (data == 10)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # word begins and ends alternate
    begin, end = edge[0::2], edge[1::2]
    up, down = powers(len(data))
    sums = BYTE_VALUES[data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    before, scale = sums[begin - 1], down[begin]
    value = mix((sums[end - 1] - before) * scale)
    places = np.searchsorted(begin, starts)
    heads = [mix((sums[np.minimum(end, begin + size) - 1] - before) * scale) for size in prefixes]
    return value, begin, end, np.diff(np.append(places, len(begin))), *heads


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


class Counter:
    """Counts of 64-bit keys in bounded memory: ``full`` tells when to empty it."""

    def __init__(self, most: int = 6_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.parts.append(counted(keys) if counts is None else (keys, counts))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self.compact()

    def compact(self) -> None:
        if len(self.parts) > 1:
            self.parts = [counted(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.size > self.most // 2 and len(self.parts) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.compact()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


class Table:
    """A hash table from 64-bit keys to values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, 3 * len(keys))))))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, values.dtype)
        self.used = np.zeros(1 << bits, bool)
        todo, at, self.steps = np.arange(len(keys)), (keys & self.mask).astype(np.int64), 0
        while len(todo):
            spot = at[todo]
            free = ~self.used[spot]
            _, firsts = np.unique(spot, return_index=True)
            chosen = np.zeros(len(todo), bool)
            chosen[firsts] = True
            chosen &= free
            here, rows = spot[chosen], todo[chosen]
            self.used[here], self.keys[here], self.values[here] = True, keys[rows], values[rows]
            todo = todo[~chosen]
            at[todo] = (at[todo] + 1) & int(self.mask)
            self.steps += 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 for those that aren't held."""
        out = np.full(len(keys), -1, np.int64)
        at = (keys & self.mask).astype(np.int64)
        todo = None
        for _ in range(self.steps + 1):
            k, spot = (keys, at) if todo is None else (keys[todo], at[todo])
            hit = (self.keys[spot] == k) & self.used[spot]
            if todo is None:
                out[hit] = self.values[spot[hit]]
                todo = np.flatnonzero(~hit & self.used[spot])
            else:
                out[todo[hit]] = self.values[spot[hit]]
                todo = todo[~hit & self.used[spot]]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & int(self.mask)
        return out


def pack(*arrays: np.ndarray) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(blob)
