"""Keys of 23-bit words by the perfect binary Golay code: two words at most 2 bits apart share a key.

Each word is within 3 bits of exactly one codeword. For words x and y at most 2 bits apart some word z
is at most 1 bit from both, and the codeword within 3 bits of z is within 4 bits of x and of y. The keys
of a word are therefore all codewords within 4 bits: one if the word is at most 2 bits from the code,
six if it is 3 bits away (the weight-7 codewords through three given positions number five).
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the (23, 12, 7) code.
GENERATOR = 0b110001110101
CHECK_BITS, DATA_BITS = 11, 12


def _remainder(word: int) -> int:
    for i in range(22, CHECK_BITS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK_BITS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the low 12 bits, of the high 11 bits, error by syndrome, number of keys, key offsets)."""
    low = np.array([_remainder(i) for i in range(1 << 12)], np.int32)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.int32)
    error = np.zeros(1 << CHECK_BITS, np.int32)
    for weight in (1, 2, 3):
        for at in combinations(range(23), weight):
            word = sum(1 << i for i in at)
            error[low[word & 0xFFF] ^ high[word >> 12]] = word
    data = np.arange(1 << DATA_BITS, dtype=np.int64)
    words = data << CHECK_BITS
    words |= low[words & 0xFFF] ^ high[words >> 12]
    sevens = words[np.bitwise_count(words) == 7]
    many, offsets = np.ones(1 << CHECK_BITS, np.int64), np.zeros((1 << CHECK_BITS, 6), np.int64)
    for s, e in enumerate(error):
        if int(e).bit_count() == 3:
            near = sevens[(sevens & e) == e] >> CHECK_BITS
            many[s] = 1 + len(near)
            offsets[s, 1 : 1 + len(near)] = near
    return low, high, error, many, offsets


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 keys of 12 bits each, number of them that count) of n words of 23 bits."""
    low, high, error, many, offsets = tables()
    words = words.astype(np.int64)
    s = low[words & 0xFFF] ^ high[words >> 12]
    return ((words ^ error[s]) >> CHECK_BITS)[:, None] ^ offsets[s], many[s]
