"""The perfect binary Golay code [23, 12, 7] over numpy arrays.

Every 23-bit word is within 3 bits of exactly one codeword. A word at distance 3
from it has five more codewords at distance 4. So if two words differ in at most
one bit, the nearest codeword of either is among those within 4 bits of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH = 23
CHECKS = 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the high bits; for each remainder the lightest error pattern
    and, where that has 3 bits, the five patterns of 4 bits (else -1)."""
    high = np.array([_remainder(i << CHECKS) for i in range(1 << (LENGTH - CHECKS))], dtype=np.int64)
    lightest = np.zeros(1 << CHECKS, dtype=np.int64)
    others = np.full((1 << CHECKS, 5), -1, dtype=np.int64)
    filled = np.zeros(1 << CHECKS, dtype=np.int64)
    of_bit = [_remainder(1 << b) for b in range(LENGTH)]
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(LENGTH), weight):
            left, word = 0, 0
            for b in bits:
                left ^= of_bit[b]
                word |= 1 << b
            if weight < 4:
                lightest[left] = word
            else:
                others[left, filled[left]] = word
                filled[left] += 1
    return high, lightest, others


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 bits of each word: (n, 6), the nearest
    first, -1 where there is none."""
    high, lightest, others = _tables()
    words = words.astype(np.int64)
    left = high[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))
    found = np.empty((len(words), 6), dtype=np.int64)
    found[:, 0] = (words ^ lightest[left]) >> CHECKS
    more = others[left]
    found[:, 1:] = np.where(more < 0, -1, (words[:, None] ^ more) >> CHECKS)
    return found
