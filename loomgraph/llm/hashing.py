"""Vectorised hashes of substrings of a byte array: of words, of word runs, of fixed windows."""

from __future__ import annotations

import numpy as np

_GAMMA = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GAMMA) + np.uint64(seed))


class Rolling:
    """Hashes of byte ranges, mod 2**64, from prefix sums of value(byte) * base ** position."""

    def __init__(self, seed: int) -> None:
        self.values = _table(seed)
        self.base = int(_table(seed + 1)[0]) | 1  # odd, so it has an inverse
        if self.base % 8 in (1, 7):
            self.base += 2  # 3 or 5 mod 8: the order of the base is as long as it can be
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            k = len(self.powers)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, own * np.uint64(pow(base, k, 1 << 64))]))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """n + 1 prefix sums, for `ranges`."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[starts[i]:ends[i]]: equal bytes give equal hashes wherever they are."""
        return mix64((prefix[ends] - prefix[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hash of every window of `size` bytes."""
        n = len(prefix) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix64((prefix[size:] - prefix[:-size]) * self.inverses[:n])


def word_spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't breaks (breaks: a table of 256 booleans)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~breaks[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]
