"""The binary Golay code of length 23: nearest codewords as fuzzy keys.

The code is perfect: every 23-bit word lies within 3 bits of one codeword. A word 3 bits from its
codeword also has exactly five codewords at 4 bits. If two words differ in at most one bit, the
nearest codeword of either is among these (one or six) codewords of the other: it is at most
3 + 1 bits away.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, INFORMATION = 23, 12
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
CHECK = LENGTH - INFORMATION


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator."""
    rest = words.astype(np.uint32)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest = np.where((rest >> np.uint32(bit)) & np.uint32(1), rest ^ np.uint32(GENERATOR << (bit - CHECK)), rest)
    return rest


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: error patterns to the codewords within reach (unused places repeat the nearest), and their number."""
    near = np.zeros((1 << CHECK, 6), dtype=np.uint32)
    count = np.zeros(1 << CHECK, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], dtype=np.uint32)
        for s, p in zip(syndrome(patterns), patterns):
            if weight < 4 or near[s, 0].bit_count() == 3:
                near[s, count[s]] = p
                count[s] += 1
    for k in range(1, 6):
        near[:, k] = np.where(count > k, near[:, k], near[:, 0])
    return near, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords in reach of each word, nearest first: shape (n, 6), and how many count."""
    near, count = tables()
    s = syndrome(words)
    return (words.astype(np.uint32)[:, None] ^ near[s]) >> np.uint32(CHECK), count[s]
