"""Word shingles as sorted sets of 64-bit hashes, whole columns of texts at a time.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased; a shingle is ``width``
consecutive words, and a text of fewer words (but some) has its whole sequence as one.
A word's hash is a polynomial over random 64-bit values of its UTF-8 bytes, taken from
prefix sums; a shingle's hash mixes its words' hashes in order.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

PIECE = 1 << 21
#: Texts from this size on go alone.
LONG = PIECE // 2
#: Whitespace becomes a space, A-Z become a-z.
FOLD = bytes(c | 0x20 if 0x41 <= c <= 0x5A else 0x20 if 9 <= c <= 13 else c for c in range(256))
_RNG = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE, _MIX, _STEP = (int(x) | 1 for x in _RNG.integers(0, 1 << 63, 3, np.uint64))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, made where they are needed first."""
    size = PIECE + (1 << 16)
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        each = np.full(size, x, np.uint64)
        each[0] = 1
        out.append(np.multiply.accumulate(each))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Spans:
    """Words of a buffer of little more than ``PIECE`` bytes at most, which begins and ends with a space, and hashes of any of its spans."""

    def __init__(self, folded: bytes) -> None:
        self.raw = np.frombuffer(folded, np.uint8)
        space = self.raw == 0x20
        self.start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        powers, self.inverse = _powers()
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.raw] * powers[: len(self.raw)], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def _word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; ``folded`` begins and ends with a space."""
    spans = Spans(folded)
    return spans.hashes(spans.start, spans.end), spans.start


def _long_text(folded: bytes) -> np.ndarray:
    """Word hashes of one large text, a piece at a time; a word of ``LONG`` bytes or more has a digest instead."""
    out, held, size = [], [], 0

    def flush():
        nonlocal held, size
        if held:
            out.append(_word_hashes(b" " + b" ".join(held) + b" ")[0])
        held, size = [], 0

    for word in folded.split(b" "):
        if len(word) >= LONG:
            flush()
            out.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64))
        elif word:
            if size + len(word) + 1 > LONG:
                flush()
            held.append(word)
            size += len(word) + 1
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(words: np.ndarray, bounds: list[tuple[int, int]], width: int) -> list[np.ndarray]:
    """``bounds``: where each text's words begin and end."""
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(_MIX) + words[k : len(words) - width + 1 + k]
    rolled = mixed(rolled * np.uint64(_STEP))
    out = []
    for a, b in bounds:
        if b - a >= width:
            found = np.sort(rolled[a : b - width + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = np.uint64((int(h) * _STEP + int(w)) & ((1 << 64) - 1))
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def word_groups(texts: list[bytes | None]):
    """Yields (indices of texts, hashes of their words, where each text's words begin and end), all texts in order."""
    group: list[int] = []
    folded: list[bytes] = []
    size = 0

    def flush():
        starts = np.cumsum([1] + [len(p) + 1 for p in folded])
        words, at = _word_hashes(b" " + b" ".join(folded) + b" ") if folded else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cut = np.searchsorted(at, starts).tolist()
        return group, words, [*zip(cut[:-1], cut[1:], strict=True)]

    for i, text in enumerate(texts):
        line = (text or b"").translate(FOLD)
        if len(line) >= LONG:
            yield flush()
            words = _long_text(line)
            yield [i], words, [(0, len(words))]
            group, folded, size = [], [], 0
            continue
        if size + len(line) + 1 > PIECE:
            yield flush()
            group, folded, size = [], [], 0
        group.append(i)
        folded.append(line)
        size += len(line) + 1
    yield flush()


def shingle_sets(texts: list[bytes | None], width: int = 4):
    """Yields (index, sorted set of hashes) for every text, in order."""
    for group, words, bounds in word_groups(texts):
        yield from zip(group, _sets(words, bounds, width), strict=True)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair of hashes."""
    return mixed(first * np.uint64(_MIX) + second)


def identity(found: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mixed(found + np.uint64(_STEP)), dtype=np.uint64)
        folded = np.bitwise_xor.reduce(mixed(found ^ np.uint64(_MIX)))
        return int(mixed(np.array([total * np.uint64(_BASE) + folded + np.uint64(len(found))], np.uint64)).view(np.int64)[0])
