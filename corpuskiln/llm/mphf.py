"""A minimal perfect hash over 64-bit keys, built and probed with numpy.

Each level is a bit array twice as long as the keys still unplaced; keys alone
on their bit are placed, the rest go to the next level.  A key's slot is the
number of set bits before its own.  What the last level leaves (hardly ever
any) is kept sorted behind the levels, so every key set has a hash.
"""

from __future__ import annotations

import numpy as np

from corpuskiln.llm.common import mix

LEVELS = 24
_STEP = 0xD6E8FEB86659FD93


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * _STEP & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[bytes], bytes]:
    """Levels (bits, in 64-bit words) and the sorted rest. ``keys`` are distinct."""
    levels, left = [], keys
    while len(left) and len(levels) < LEVELS:
        size = (2 * len(left) + 63) // 64 * 64
        spot = _spot(left, len(levels), size)
        alone = np.bincount(spot, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~alone[spot]]
    return levels, np.sort(left).tobytes()


class Slots:
    """Probes a built hash; keys outside the built set get any slot or -1.

    Bits stay packed; a 32-bit count stands before each word, so a key takes some five bits."""

    def __init__(self, levels: list[bytes], rest: bytes):
        self.words, self.ranks, self.before, placed = [], [], [], 0
        for level in levels:
            words = np.frombuffer(level, "<u8")
            ends = np.cumsum(np.bitwise_count(words), dtype=np.uint32)
            self.words.append(words)
            self.ranks.append(np.r_[np.uint32(0), ends[:-1]])
            self.before.append(placed)
            placed += int(ends[-1])
        self.rest, self.placed = np.frombuffer(rest, np.uint64), placed

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks, before) in enumerate(zip(self.words, self.ranks, self.before)):
            if not len(open_):
                return out
            spot = _spot(keys[open_], level, 64 * len(words))
            at, bit = spot >> 6, (spot & 63).astype(np.uint64)
            word = words[at]
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (before + ranks[at].astype(np.int64) + below)[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.placed + at[hit]
        return out
