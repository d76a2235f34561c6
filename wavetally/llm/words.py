"""Words of a UTF-8 text and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def alnum_words(text: bytes) -> list[bytes]:
    """ASCII-lower-cased runs of digits, letters and non-ASCII characters."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """ASCII-lower-cased runs of anything but ASCII white space."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (arithmetic modulo 2**64)."""
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _ODD2
    return h ^ (h >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words; of all words together if there are fewer, none if none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total = mix(total + hashes[i : n - k + 1 + i])
    return total
