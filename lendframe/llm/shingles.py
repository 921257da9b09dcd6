"""Words and word shingles as 64-bit hashes, vectorised over many texts.

Texts are UTF-8 bytes with A-Z lower-cased.  A word is a run of bytes that
are not separators, so any word pattern over bytes is one 256-entry table.
Memory per call: about 40 bytes for each byte of a block (128 KB, cut between
words), plus 8 bytes for each word of the given texts.
"""

from __future__ import annotations

import numpy as np

#: Separators [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators [\x00-\x2F\x3A-\x60\x7B-\x7F] (after lower-casing: words are a-z, 0-9 and all beyond ASCII).
NON_WORD = np.zeros(256, bool)
NON_WORD[:0x30] = NON_WORD[0x3A:0x61] = NON_WORD[0x7B:0x80] = True

BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _random64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes words: polynomial over random byte values modulo 2^64, mixed."""

    def __init__(self, separators: np.ndarray):
        self.sep = separators
        self.value = _random64(1, 256)
        self.value[separators] = 0
        self._powers(BLOCK + 1)

    def _powers(self, n: int) -> None:
        self.up, self.down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        for powers in (self.up, self.down):
            powers[0] = 1
            np.cumprod(powers, out=powers)

    def _block(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word starts and hashes of a block that begins and ends between words."""
        if len(buf) >= len(self.up):
            self._powers(len(buf) + 1)
        sep = self.sep[buf]
        first = ~sep
        first[1:] &= sep[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        sums = np.add.reduceat(self.value[buf] * self.up[: len(buf)], starts)
        return starts, mix(sums * self.down[starts])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words begin (n + 1 offsets)."""
        buf = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts, hashes, at = [], [], 0
        while at < len(buf):
            stop = min(at + BLOCK, len(buf))
            while stop < len(buf):
                gap = np.flatnonzero(self.sep[buf[max(at, stop - BLOCK): stop]])
                if len(gap):
                    stop = max(at, stop - BLOCK) + int(gap[-1]) + 1
                    break
                stop = min(stop + BLOCK, len(buf))  # a word longer than a block
            s, h = self._block(buf[at:stop])
            starts.append(s + at)
            hashes.append(h)
            at = stop
        if not starts:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def windows(words: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within each text, at their first
    word's index (texts with fewer words have none)."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    keep = np.zeros(n, bool)
    if n < k:
        return out, keep
    weight = _random64(1000 + seed, k) | np.uint64(1)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words[j: n - k + 1 + j] * weight[j]
    out[: n - k + 1] = mix(total)
    last = np.repeat(offsets[1:], np.diff(offsets))
    keep[:] = np.arange(n) + k <= last
    return out, keep


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``k`` words of each text, in order and with repeats, as
    hashes and n + 1 offsets.  A text with fewer words is one shingle; one
    without words has none."""
    out, keep = windows(words, offsets, k)
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        weight = _random64(2000, k) | np.uint64(1)
        first, n = offsets[short], counts[short]
        total = n.astype(np.uint64) * np.uint64(_BASE)
        for j in range(k):
            inside = j < n
            total[inside] += words[first[inside] + j] * weight[j]
        out[first] = mix(total)
        keep[first] = True
    sizes = np.maximum(counts - k + 1, (counts > 0).astype(counts.dtype))
    return out[keep], np.concatenate(([0], np.cumsum(sizes)))


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[new], minlength=len(offsets) - 1)
    return values[new], np.concatenate(([0], np.cumsum(counts)))
