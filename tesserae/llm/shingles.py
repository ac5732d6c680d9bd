"""Word shingles of texts as sorted arrays of 64-bit hashes, computed over whole byte buffers with numpy.

Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z. A set holds the distinct k-word
shingles; a text of fewer than k words (but one at least) has the whole sequence as its one shingle; a null text or one
without words has the empty set. Two different shingles share a hash with a chance of 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buf: np.ndarray) -> np.ndarray:
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = _SPACE[buf]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words in order; long texts go in chunks cut at white space, so memory stays bounded."""
    buf = np.frombuffer(text, np.uint8)
    if len(buf) <= _CHUNK:
        return _words(buf)
    out, at = [], 0
    while at < len(buf):
        to = min(len(buf), at + _CHUNK)
        while to < len(buf):
            back = np.flatnonzero(_SPACE[buf[max(at, to - 4096) : to]])
            if len(back):
                to = max(at, to - 4096) + int(back[-1]) + 1
                break
            to = min(len(buf), to + 4096)
        out.append(_words(buf[at:to]))
        at = to
    return np.concatenate(out)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    n = min(k, len(w))
    h = w[: len(w) - n + 1] + np.uint64(n)
    for i in range(1, n):
        h = mix(h * np.uint64(0x9FB21C651E98DF25)) + w[i : len(w) - n + 1 + i]
    return np.unique(mix(h))


def digest(items: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
