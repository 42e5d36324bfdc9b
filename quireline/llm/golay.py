"""The binary Golay code (23, 12): a perfect code, so every 23-bit word is within three bits of one codeword."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainders() -> np.ndarray:
    """The syndrome (remainder by the generator) of each single bit."""
    out = []
    for bit in range(23):
        x = 1 << bit
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        out.append(x)
    return np.array(out, dtype=np.int64)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The syndromes of each value of the low 12 bits and of the high 11 bits in one table each, and the error of each syndrome."""
    bits = _remainders()
    parts = [np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 11, dtype=np.int64)]
    for part, first in zip(parts, (0, 12), strict=True):
        for k in range(len(part).bit_length() - 1):
            part[1 << k : 2 << k] = part[: 1 << k] ^ bits[first + k]
    errors = np.zeros(1 << 11, dtype=np.int64)
    for a in range(23):
        errors[bits[a]] = 1 << a
        for b in range(a):
            errors[bits[a] ^ bits[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[bits[a] ^ bits[b] ^ bits[c]] = 1 << a | 1 << b | 1 << c
    return np.concatenate(parts), errors


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    syndromes, errors = _tables()
    syndrome = syndromes[words & 0xFFF] ^ syndromes[(1 << 12) + (words >> 12)]
    return (words ^ errors[syndrome]) >> 11


def nearby(words: np.ndarray, width: int) -> np.ndarray:
    """Indices for words and their one-bit neighbours in the low ``width`` bits, one row for each word, ascending, with repeats.

    Two words that differ in at most one of those bits have an index in common: each has the other
    among its neighbours. A word nearer than three bits to its codeword has that index alone;
    others have up to five more, those of the codewords four bits away.
    """
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int64)
    return np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
