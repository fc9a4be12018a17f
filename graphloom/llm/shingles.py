"""Word and shingle hashes, minima and their signatures."""

from __future__ import annotations

import numpy as np
import xxhash

#: Minima in a signature, one byte of each; standard deviations by which an estimate may fall short.
LANES, SLACK = 128, 6.0

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word between ASCII white space, in order.

    ``data`` is UTF-8 with A-Z lower-cased by the caller (``bytes.lower``).
    """
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``k``-word shingles of lower-cased UTF-8 ``data``.

    With fewer than ``k`` words the whole sequence is one shingle; no words give an empty set.
    """
    words = word_hashes(data)
    if not len(words):
        return words
    size = min(k, len(words))
    value = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        value = mix(value * np.uint64(0xFF51AFD7ED558CCD) + words[i : len(words) - size + 1 + i])
    return np.unique(value)


class MinHasher:
    """Many universal hash minima: the upper 24 bits of ``(a * x + b) mod 2**32`` for seeded odd ``a`` (multiply-shift)."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """One 24-bit minimum for each hash function; ``shingles`` must not be empty."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 128):
            part = x[i : i + 128, None] * self.a
            part += self.b
            np.minimum(out, part.min(axis=0), out=out)
        return out >> np.uint32(8)

    def signature(self, minima: np.ndarray) -> bytes:
        """One byte of each of the first LANES minima."""
        return (minima[:LANES] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of ``rows`` minima; the band's number is part of it."""
        rows = minima.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            key = mix(key * np.uint64(0xFF51AFD7ED558CCD) + rows[:, i])
        return key


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| on sorted distinct arrays, counted in integers."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def least_agreement(percent: int, lanes: int) -> int:
    """Equal lanes of two signatures below which their similarity is, but for a chance of about 1e-9, under ``percent``."""
    t = percent / 100
    return int(lanes * max(0.0, t - SLACK * (t * (1 - t) / lanes) ** 0.5))
