"""A minimal perfect hash of 64-bit keys that stores its keys, over numpy arrays.

Each level hashes the keys that are left to twice as many places; a key alone at its place is settled there, the others go on.
A key's slot is the number of settled places before its own, over all levels: the slots are 0 to ``n - 1``.  A key that
is none of the ``n`` may meet a settled place as well, so every slot is verified against the key stored for it.
"""

from __future__ import annotations

import numpy as np

from tallyrill.llm.shingles import mixed

#: Places a key, and levels: the chance that one of four million keys is left after so many is below 1e-30.
SPREAD, LEVELS = 2, 64


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & ((1 << 64) - 1))
    return ((mixed(keys ^ seed) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots of distinct ``uint64`` keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        ordered, left, settled = [np.zeros(0, np.uint64)], keys.astype(np.uint64), 0
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(64, -(-SPREAD * len(left) // 64) * 64)
            at = _places(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ranks = settled + np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
            self.levels.append((size, bits, ranks))
            here = alone[at]
            ordered.append(left[here][np.argsort(at[here])])
            settled += int(here.sum())
            left = left[~here]
        self.keys = np.concatenate(ordered)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = _places(keys[left], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot = ranks[word] + np.bitwise_count(below)
            at_home = found.copy()
            at_home[found] = self.keys[slot[found]] == keys[left[found]]
            out[left[at_home]] = slot[at_home]
            left = left[~found]  # a place that is settled by another key ends the search
            if not len(left):
                break
        return out
