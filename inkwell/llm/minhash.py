"""Shingle sets as hashes and their circulant MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np

from .hashing import BASE, hashed_words, mix

STEP = 0x9E3779B1


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text; one for a text of fewer words than ``width``, none without words."""
    words, begins = hashed_words(texts)
    n = max(len(words) - width + 1, 0)
    rolling = np.zeros(n, np.uint64)
    for k in range(width):
        rolling = mix(rolling * BASE + words[k : k + n]) if n else rolling
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolling[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mix(h * BASE + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], size: int, chunk: int = 1 << 15) -> np.ndarray:
    """Circulant MinHash: (sets, size) of uint32. The sets must not be empty."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    begin = 0
    while begin < len(sets):
        end, total = begin, 0
        while end < len(sets) and (end == begin or total + len(sets[end]) <= chunk):
            total += len(sets[end])
            end += 1
        first = (mix(np.concatenate(sets[begin:end])) >> np.uint64(32)).astype(np.uint32)
        starts = np.zeros(end - begin, np.int64)
        np.cumsum([len(s) for s in sets[begin : end - 1]], out=starts[1:])
        v, t = np.empty_like(first), np.empty_like(first)
        for k in range(size):
            np.add(first, np.uint32(STEP * (k + 1) & 0xFFFFFFFF), out=v)
            np.multiply(v, np.uint32(0x85EBCA6B), out=v)
            np.right_shift(v, np.uint32(15), out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, np.uint32(0xC2B2AE35), out=v)
            np.right_shift(v, np.uint32(16), out=t)
            np.bitwise_xor(v, t, out=v)
            out[begin:end, k] = np.minimum.reduceat(v, starts)
        begin = end
    return out
