"""Sorted hashes and counts as few bytes, for rows that carry blocks of them."""

from __future__ import annotations

import numpy as np


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def counts_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1").astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, highest bytes first, as those are mostly 0 and compress."""
    return np.diff(keys, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def keys_of(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)
