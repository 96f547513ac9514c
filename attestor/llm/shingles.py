"""Word shingles of whole texts as sets of 64-bit hashes, and min-max signatures of the sets."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Hashes worked on at once.
_CHUNK = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of `size` words. A-Z are lower-cased, words end at ASCII white space.
    A text of fewer words has its whole sequence as one shingle; without words the set is empty."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out + _MIX[2] + hashed[k : k + n] * np.uint64(2 * k + 1))
    return np.unique(out)


def digest(hashes: np.ndarray) -> bytes:
    """A 128-bit digest of a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 1 << 32, count, np.uint32)


def min_max(hashes: np.ndarray, multipliers: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The minimum and the maximum of the set under each permutation of 32-bit integers: twice as many values as
    permutations."""
    least = np.full(len(masks), np.iinfo(np.uint32).max, np.uint32)
    most = np.zeros(len(masks), np.uint32)
    short = hashes.astype(np.uint32)
    for k in range(0, len(short), _CHUNK):
        x = short[None, k : k + _CHUNK] ^ masks[:, None]
        x *= multipliers[:, None]
        np.minimum(least, x.min(axis=1), out=least)
        np.maximum(most, x.max(axis=1), out=most)
    return np.concatenate((least, most))


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` values; equal keys mean equal values in the same band."""
    parts = signature.astype(np.uint64)[: len(signature) // rows * rows].reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for k in range(rows):
        key = mix(key * _MIX[2] + parts[:, k])
    return key


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int((b[place] == a).sum())
