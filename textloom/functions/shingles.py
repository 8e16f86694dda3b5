"""Word n-grams as hashes, and MinHash signatures of their sets, in numpy."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on whole arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it has grown, so its memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def shingle_hashes(text: str, words: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word n-grams of ``text``."""
    tokens = WORD.findall(text.lower())
    n = len(tokens) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    acc = h[:n]
    for k in range(1, words):
        acc = mix(acc + MULT) + h[k : k + n]
    return np.unique(mix(acc))


def permutations(coordinates: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, coordinates, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """MinHash: of each salted order, the least value, as 32 bits."""
    x = (shingles[None, :] ^ salts[:, None]) * MULT
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x.min(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
