"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD1342543DE82EF95  # odd, so that its powers have inverses modulo 2 ** 64

#: Bytes that are hashed at once; longer texts are cut between words.
SEGMENT = 1 << 20


def _table() -> np.ndarray:
    """A random number for each byte, the same for both cases of A-Z."""
    t = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
    t[65:91] = t[97:123]
    return t


_BYTE = _table()
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class _Powers:
    """Powers of _P and of its inverse, as many as the longest segment needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            step = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64)
            self.up, self.down = step(_P), step(pow(_P, -1, 1 << 64))
        return self.up, self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (two multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _segment(b: np.ndarray) -> np.ndarray:
    """Hashes of the words in some bytes: sum of number(byte) * P ** place modulo 2 ** 64,
    as differences of running sums, each scaled back to its word's start."""
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    if not space[-1]:
        edge = np.r_[edge, len(b)]
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: A-Z lower-cased, split at space and the bytes 9 to 13."""
    b = np.frombuffer((text or "").encode(), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    if len(b) <= SEGMENT:
        return _segment(b)
    out, at = [], 0
    while at < len(b):
        end = at + SEGMENT
        while end < len(b):  # to the next space
            gap = np.flatnonzero(_SPACE[b[end : end + SEGMENT]])
            if len(gap):
                end += int(gap[0])
                break
            end += SEGMENT
        out.append(_segment(b[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles, sorted. Fewer words than `size`: the whole sequence is one; no word: none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * _M + w[i : len(w) - k + 1 + i]
    return np.unique(mix(h + np.uint64(k)))
