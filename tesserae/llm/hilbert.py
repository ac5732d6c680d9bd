"""Hilbert curve positions of points on a grid of any dimension, vectorised over points."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """points: (n, m) whole numbers below 2**bits, m * bits <= 62. Positions along the curve, as int64.

    The transposed form is found by undoing excess work from the highest bit down and then Gray encoding.
    """
    x = points.astype(np.int64).T.copy()
    m = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(m):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[m - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = key << 1 | (x[i] >> b) & 1
    return key
