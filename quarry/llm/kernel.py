"""Vectorised word and n-gram hashing over many texts at once (numpy, runs inside Spark tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Word characters of the three tokenisations, by byte.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_pow[0]) < n:
        m = max(n, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class Words:
    """The words of a slice of texts: byte spans, 64-bit hashes, and the first word of each text (`first`, one more than texts)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, chars: np.ndarray = SPACED, lower: bool = False):
        self.buf = buf = LOWER[buf] if lower else buf
        n = len(buf)
        word = chars[buf]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
            before[off[:-1][off[:-1] < n]] = False
            after[off[1:][off[1:] > 0] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self._h = None

    @property
    def hash(self) -> np.ndarray:
        if self._h is None:
            n = len(self.buf)
            up, down = _powers(n + 1)
            c = np.zeros(n + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + _U(1)) * up[:n], out=c[1:])
            self._h = mix((c[self.end] - c[self.start]) * down[self.start])
        return self._h

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def ends(self) -> np.ndarray:
        """For each word, the end of its text's words."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def text(self) -> np.ndarray:
        """For each word, its text's place in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and whether those k words lie in one text (both as long as the words less k - 1)."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        g = chain(self.hash, k, seed)
        return g, np.arange(k, n + k) <= self.ends()[:n]


def chain(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Order-sensitive hashes of k consecutive elements of h, for each start."""
    n = len(h) - k + 1
    b = _U((0xD6E8FEB86659FD93 * (2 * int(seed) + 1)) & (2**64 - 1) | 1)
    g = np.full(n, _U(int(k) * 0x1000193 + int(seed)), np.uint64)
    for j in range(k):
        g *= b
        g += h[j : j + n]
    return mix(g)


def chain_at(h: np.ndarray, starts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """chain(h, k, seed) at the given starts only."""
    b = _U((0xD6E8FEB86659FD93 * (2 * int(seed) + 1)) & (2**64 - 1) | 1)
    g = np.full(len(starts), _U(int(k) * 0x1000193 + int(seed)), np.uint64)
    for j in range(k):
        g *= b
        g += h[starts + j]
    return mix(g)


def winnow(g: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """True at the minimum k-gram hash of each window of w consecutive valid k-grams (winnowing; equal minima all count).

    A window lies in one text where its last k-gram and all before it are valid; texts with fewer than w k-grams select none.
    """
    n = len(g) - w + 1
    picked = np.zeros(len(g), bool)
    if n <= 0:
        return picked
    low, full = g[:n].copy(), ok[:n].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + n], out=low)
        full &= ok[j : j + n]
    for j in range(w):
        picked[j : j + n] |= (g[j : j + n] == low) & full
    return picked


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array among."""
    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """True for each of n places that lies in one of the spans [start, start + length)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:n]) > 0
