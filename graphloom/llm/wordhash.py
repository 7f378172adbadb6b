"""64-bit hashes of words and word n-grams, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words; empty if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, "u8")
    out = hashes[:size].copy()
    for i in range(1, n):
        out *= _FACTOR
        out += hashes[i : i + size]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-grams of a text; one of all its words if it has fewer than n."""
    if 0 < len(hashes) < n:
        n = len(hashes)
    return np.unique(gram_hashes(hashes, n))
