"""The binary Golay code of length 23 as a fuzzy hash for 64-bit fingerprints.

The code is perfect: each 23-bit word is within 3 bits of exactly one codeword,
and within 4 bits of about five.  Two words that differ in at most 2 bits share
a codeword within 4 bits of both: the one nearest to a word between them.  If
they differ in one bit, the nearest codeword of either is within 4 bits of the
other.

A fingerprint has three segments of 22, 21 and 21 bits.  If two fingerprints
differ in at most 4 bits, then either one segment is equal and another differs in
at most 2 bits, or two segments differ in exactly one bit.  So each fingerprint
gets keys of two kinds:

* an equal segment with each codeword within 4 bits of another segment;
* for two segments, the nearest codeword of one with each codeword within 4 bits
  of the other, both ways.

Any two fingerprints within 4 bits share a key; sharing one is verified.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Largest distance at which the keys find every pair.
MOST_BITS = 4


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high 11 and low 12 bits; error patterns by syndrome.

    Row s of the patterns holds all of at most 4 bits with syndrome s, the one of
    at most 3 bits first, filled up with -1.
    """
    high = np.array([_syndrome(w << 12) for w in range(1 << 11)], dtype=np.int64)
    low = np.array([_syndrome(w) for w in range(1 << 12)], dtype=np.int64)
    by_syndrome: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            by_syndrome[high[pattern >> 12] ^ low[pattern & 4095]].append(pattern)
    width = max(map(len, by_syndrome))
    patterns = np.full((1 << 11, width), -1, dtype=np.int64)
    for s, found in enumerate(by_syndrome):
        patterns[s, : len(found)] = found
    return high, low, patterns, (patterns >= 0).sum(1)


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 bits of each word, the nearest first; -1 fills."""
    high, low, patterns, _ = _tables()
    errors = patterns[high[words >> 12] ^ low[words & 4095]]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all keys of uint64 fingerprints."""
    parts = [
        ((fingerprints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS
    ]
    near = [codewords(p) for p in parts]
    where, found = [], []

    def emit(tag: int, first: np.ndarray, second: np.ndarray) -> None:
        key = (np.int64(tag) << 40) | (first << 12) | second
        at, column = np.nonzero((first >= 0) & (second >= 0))
        where.append(at)
        found.append(np.broadcast_to(key, (len(fingerprints), key.shape[1]))[at, column])

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                emit(tag, np.broadcast_to(parts[i][:, None], near[j].shape), near[j])
                tag += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        emit(tag, np.broadcast_to(near[i][:, :1], near[j].shape), near[j])
        # the nearest of both is among those already
        emit(tag, near[i][:, 1:], np.broadcast_to(near[j][:, :1], near[i][:, 1:].shape))
        tag += 1
    return np.concatenate(where), np.concatenate(found)
