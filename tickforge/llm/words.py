"""Whole batches of text as NumPy arrays: word boundaries and 64-bit hashes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is
the same as the pattern ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
_FOLD = U(0xC2B2AE3D27D4EB4F)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, _BLOCK + 65536)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U(base))
            p[0] = 1
            _tables[name] = np.cumprod(p, dtype=U)
    return _tables["up"], _tables["down"]


def split_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of every word of a byte array."""
    space = SPACE[buf]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and 64-bit hashes of every word, a megabyte of text at a time.

    The hash is a polynomial over the bytes, read off prefix sums modulo 2**64
    and finished by ``mix``; blocks end at word ends, so memory is bounded by
    the block and the longest word.
    """
    start, end = split_words(buf)
    hashes = np.empty(len(start), U)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _BLOCK, side="right")))
        part = buf[base : end[j - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        hashes[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * _FOLD)
        i = j
    return start, end, hashes


def fold(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive hashes (in order)."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, U)
    for k in range(n):
        out = out * _FOLD + hashes[k : k + m]
    return mix(out)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return first, np.diff(np.concatenate((first, [len(keys)])))
