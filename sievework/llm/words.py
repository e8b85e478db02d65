"""Words of whole texts as 64-bit hashes, computed for many texts at once on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        tables = []
        for x in (_BASE, _INVERSE):
            t = np.full(n, x, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def hashed(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of each word [^\\x20\\x09-\\x0D]+, in order; A-Z are lower-cased first; places are bytes in the text."""
    data = b" ".join(texts) + b" "
    codes = np.frombuffer(data.lower() if lower else data, "u1")
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    blank = _BLANK[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view("i1")))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.add(codes, U(1), out=total[1:])
    total[1:] *= down[: len(codes)]
    np.cumsum(total[1:], out=total[1:])
    h = mix((total[end] - total[start]) * up[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(begin, start, "right") - 1
    return h, text, start - begin[text], end - begin[text]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k successive words; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(k))
    for i in range(k):
        out = (out ^ h[i : i + n]) * U(_BASE)
        out ^= out >> U(29)
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Each text's set of distinct k-word shingles, sorted; with fewer words the whole sequence is one; none without words."""
    h, text, _, _ = hashed(texts)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    all_k = shingles(h, k)
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        out.append(np.unique(all_k[a : b - k + 1]) if b - a >= k else shingles(h[a:b], int(b - a)) if b > a else h[:0])
    return out
