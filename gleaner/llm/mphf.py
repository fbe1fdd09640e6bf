"""A minimal perfect hash function over 64-bit keys, by levels of collision-free bits.

At each level, every remaining key hashes to a bit of a fresh array; keys alone
on their bit are placed there, the others go to the next level.  A key's slot
is the number of placed bits before its own, so n keys take exactly the slots
0 to n - 1, with about three bits each.
"""

from __future__ import annotations

import numpy as np

_GAMMA = 2
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A different 64-bit hash of the keys for each level."""
    x = keys ^ np.uint64((level + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Slots for a set of distinct 64-bit keys; any other key gets some slot or -1."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.sizes = [np.uint64(len(w) * 64) for w in words]
        ones = [np.bitwise_count(w).astype(np.int64) for w in words]
        before, self.ranks = 0, []
        for o in ones:
            self.ranks.append(before + np.concatenate(([0], np.cumsum(o)[:-1])).astype(np.int64))
            before += int(o.sum())
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """Raises ValueError if keys repeat."""
        keys = np.asarray(keys, np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys repeat")
        words = []
        while len(keys):
            n = -(-max(_GAMMA * len(keys), 64) // 64) * 64
            at = (mix(keys, len(words)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n)[at] == 1
            bits = np.zeros(n, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            keys = keys[~alone]
        return cls(words)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, size, ranks) in enumerate(zip(self.words, self.sizes, self.ranks, strict=True)):
            if not len(open_):
                break
            at = mix(keys[open_], level) % size
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[here]] = (ranks[word] + np.bitwise_count(below))[here]
            open_ = open_[~here]
        return out
