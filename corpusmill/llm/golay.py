"""The perfect binary Golay code of length 23 as a hash that forgives bit errors.

Every 23-bit word is within three bits of exactly one code word. keys() gives a word the code
words within three bits of it and, where the nearest one is three bits away, the five that are four
bits away. Two words that differ in at most two bits share a key (tests go through all cases). Two
that differ in one bit even share one that is the first key of either of them.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, MESSAGE, KEYS = 23, 12, 6


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, BITS - MESSAGE - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of low and high halves of a word; by syndrome the message bits of its error patterns, -1 where none."""
    one = [_remainder(1 << i) for i in range(BITS)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for i in range(BITS):
        half, bit = (low, i) if i < 12 else (high, i - 12)
        half[(np.arange(len(half)) >> bit & 1) == 1] ^= one[i]
    errors = np.full((1 << 11, KEYS), -1, np.int32)
    errors[0, 0] = 0
    used = np.zeros(1 << 11, np.int32)
    used[0] = 1
    light = np.zeros(1 << 11, bool)  # cosets whose lightest pattern has under three bits
    light[0] = True
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(BITS), weight):
            s = p = 0
            for b in bits:
                s ^= one[b]
                p |= 1 << b
            if weight < 4 or not light[s]:
                errors[s, used[s]] = p >> 11
                used[s] += 1
                light[s] |= weight < 3
    return low, high, errors


def keys(words: np.ndarray) -> np.ndarray:
    """For each word of at most 23 bits its keys, the nearest code word first: six columns, -1 where there are fewer."""
    low, high, errors = _tables()
    words = words.astype(np.int32)
    e = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(e < 0, -1, e ^ (words >> 11)[:, None])
