"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

A batch of texts is laid end to end as code points; words are maximal runs of
letters and digits of the lower-cased text, and a word's hash is a difference
of prefix sums of code points times powers of an odd base, modulo 2**64.
"""

from __future__ import annotations

import sys

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_CHAR: np.ndarray | None = None


def word_chars() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    global _WORD_CHAR
    if _WORD_CHAR is None:
        _WORD_CHAR = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _WORD_CHAR


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, in order; number of words of each text)."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = word_chars()[points]
    edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    n = len(points)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64)])
        h = (sums[end] - sums[start]) * _powers(_BASE_INV, n)[start]
        h = mix(h + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in low])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return h, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words within a text; number of them in each text)."""
    m = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + i]
        return mix(h), m
