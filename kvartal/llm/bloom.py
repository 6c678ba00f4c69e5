"""Bloom filters as bit arrays, one for each bucket of a key space."""

from __future__ import annotations

import numpy as np

from kvartal.llm.tokensets import mix

#: With these, a filter that holds as many keys as it was sized for lets 0.4 % of other keys through.
BITS_PER_KEY = 12
HASHES = 6


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers [hashes, keys] by double hashing."""
    a, b = mix(keys, 101), mix(keys, 102) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(size) for i in range(HASHES)])


def empty_bits(capacity: int) -> np.ndarray:
    """A filter for so many keys."""
    return np.zeros(max(8, -(-capacity * BITS_PER_KEY // 8)), dtype=np.uint8)


def put(bits: np.ndarray, keys: np.ndarray) -> None:
    """Set the bits of keys, in place."""
    if len(keys):
        at = _places(keys, len(bits) * 8).ravel()
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that were never put in."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    at = _places(keys, len(bits) * 8)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)
