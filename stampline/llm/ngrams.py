"""Counts of hashed character n-grams, the features of the two text classifiers."""

from __future__ import annotations

import numpy as np

ORDERS, BITS = (1, 2, 3), 14
BUCKETS = 1 << BITS
#: Characters of a text that are hashed at once.
CHUNK = 1 << 18
# Odd multipliers, one for each place of an n-gram.
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text (long texts in pieces that overlap by an n-gram less one)."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    total = None
    for at in range(0, max(len(c), 1), CHUNK):
        x = c[at : at + CHUNK + max(ORDERS) - 1]
        scaled = [(x + np.uint32(1)) * m for m in _PLACES[: max(ORDERS)]]
        hashed = []
        for k in ORDERS:
            n = min(CHUNK, len(x) - k + 1)
            if n <= 0:
                continue
            h = scaled[0][:n] + np.uint32(k * 0x7FEB352D & 0xFFFFFFFF)
            for p in range(1, k):
                h += scaled[p][p : p + n]
            hashed.append(h)
        h = np.concatenate(hashed or [np.zeros(0, np.uint32)])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - BITS)
        n = np.bincount(h, minlength=BUCKETS)
        total = n if total is None else total + n
    return total
