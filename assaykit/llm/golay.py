"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash.

A 23-bit vector is decoded to every codeword within distance 4: one if it lies within two
bits of a codeword, else six.  Two vectors at distance 2 or less have a vector within one
bit of both, whose nearest codeword is within 3 of it and so within 4 of both: they share
at least one codeword index.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, lowest power last
KEYS = 6
RADIUS = 4


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of the high 12 bits, error patterns [syndrome, KEYS] padded with -1)."""

    def remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v ^= np.where(v >> bit & 1, _GENERATOR << bit - 11, 0)
        return v

    high = remainder(np.arange(1 << 12, dtype=np.int64) << 11)
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + 1):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[int(high[e >> 11]) ^ e & 2047].append(e)
    out = np.full((1 << 11, KEYS), -1, np.int64)
    for s, es in enumerate(errors):
        out[s, : len(es)] = es
    return high, out


def indices(v: np.ndarray) -> np.ndarray:
    """[vector, KEYS] indices (12 bits) of the codewords within RADIUS; -1 where there are fewer."""
    high, errors = _tables()
    v = v.astype(np.int64)
    e = errors[high[v >> 11] ^ v & 2047]
    return np.where(e < 0, -1, (v[:, None] ^ e) >> 11)
