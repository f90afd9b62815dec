"""Vectorised hashes of words and of windows of words, for use inside tasks.

Words are white-space separated bytes; their hashes are polynomials modulo
2**64, taken from prefix sums over the whole buffer and then mixed.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_white = np.zeros(256, bool)
_white[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept for the largest n so far."""
    have = _powers.get((int(base), 0))
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[(int(base), 0)] = have
    return have[:n]


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer of bytes."""
    inside = np.empty(len(buffer) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_white[buffer], out=inside[1:-1].view(bool))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def spans_hash(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; equal spans have equal hashes."""
    n = len(buffer)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(buffer * powers(BASE, n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more entry than texts)."""
    joined = b"\n".join(texts)
    buffer = np.frombuffer(joined, np.uint8)
    starts, ends = word_spans(buffer)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=begins[1:])
    return spans_hash(buffer, starts, ends), np.searchsorted(starts, begins)


def windows_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Rolling polynomial (Rabin-Karp) hashes of every ``width`` consecutive entries."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(INVERSE, n))


def batches(texts: list[bytes], size: int = 1 << 20):
    """Slices of the list with about ``size`` bytes each."""
    begin = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield slice(begin, k + 1)
            begin, total = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
