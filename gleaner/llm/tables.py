"""Hash tables and word memories as numpy arrays, for lookups of many keys at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Multiplier of the hash of words.
_STEP = 0xD6E8FEB86659FD93
#: Characters of a text that are worked on at a time, if it has borders to be cut at.
SECTION = 1 << 19


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` elements at least."""
    return x if n <= len(x) else np.concatenate((x, np.zeros(n + n // 2 - len(x), x.dtype)))


def cut_text(text: str, borders: Callable[[np.ndarray], np.ndarray], limit: int = SECTION) -> list[str]:
    """A text in sections of ``limit`` characters at most, but for those without a border in so many.

    ``borders`` gives the places in some code points (from 1 on) where a cut
    changes no word on either side.
    """
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        cut, look = 0, at
        while not cut and look < len(text) - 1:
            places = borders(code_points(text[look : look + limit]))
            if len(places):
                cut = look + int(places[-1 if look == at else 0])
            look += limit - 1
        if not cut:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def groups_by_size(texts: list[str], limit: int = 4 * SECTION) -> list[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` characters each."""
    out, begin, size = [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            out.append((begin, k))
            begin, size = k, 0
        size += len(t)
    return [*out, (begin, len(texts))] if texts else []


class Table64:
    """Open addressing from 64-bit keys to numbers from 0 on; -1 for what is absent."""

    def __init__(self, size: int = 1 << 12):
        self.reset(size)

    def reset(self, size: int = 1 << 12) -> None:
        self.bits = max(int(size).bit_length(), 10)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        self.used = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys + (keys == 0)  # 0 marks a free slot; it shares the place of 1, which callers don't use beside it
        at = self._home(keys)
        slot = self.keys[at]
        out = np.where(slot == keys, self.values[at], -1)
        open_ = np.flatnonzero((slot != keys) & (slot != 0))
        last = len(self.keys) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            slot = self.keys[at[open_]]
            same = slot == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (slot != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are distinct and not yet there."""
        if (self.used + len(keys)) * 2 > len(self.keys):
            old, kept = self.keys, self.values
            used = old != 0
            self.reset(2 * (self.used + len(keys)))
            self.put(old[used], kept[used])
        keys = keys + (keys == 0)
        values = np.asarray(values, np.int64)
        at, last, left = self._home(keys), len(self.keys) - 1, np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            waiting = np.ones(len(keys), bool)
            waiting[placed] = False
            left = left[waiting[left]]
            at[left] = (at[left] + 1) & last
        self.used += len(keys)


class WordMemory:
    """Id sequences of words, by a hash of each word.

    ``compute`` gives the sequences of words that are not yet known.  The memory
    starts anew when it holds ``limit`` words or ``room`` ids, so its bytes are
    bounded.  Words beyond ``longest`` characters are computed each time and
    kept only until the next call.  A word that is found is compared with the
    one that is held, character by character; should two share a hash, the
    second is computed each time, so results never rest on the hash.
    """

    def __init__(self, compute: Callable[[list[str]], list[np.ndarray]], kind: str, limit: int = 600_000, longest: int = 40, room: int = 8_000_000):
        self.compute, self.kind, self.limit, self.longest, self.room = compute, kind, limit, longest, room
        powers = [1]
        for _ in range(longest + 1):
            powers.append(powers[-1] * _STEP & (1 << 64) - 1)
        self.powers = np.array(powers, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.table = Table64(1 << 16)
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, self.kind)
        # The words themselves: where their characters begin, and how many they are.
        self.spelt = np.zeros(1 << 12, np.int32)
        self.length = np.zeros(1 << 12, np.int32)
        self.letters = np.zeros(1 << 14, np.uint32)
        self.words = self.filled = self.written = 0
        self.kept = (0, 0)

    def _add(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Entries of new sequences."""
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        n, total = self.words + len(sizes), self.filled + int(sizes.sum())
        self.first, self.count, self.pool = _grown(self.first, n), _grown(self.count, n), _grown(self.pool, total)
        self.first[self.words : n] = self.filled + np.cumsum(sizes) - sizes
        self.count[self.words : n] = sizes
        if len(sizes):
            self.pool[self.filled : total] = np.concatenate(sequences)
        entries = np.arange(self.words, n)
        self.words, self.filled = n, total
        return entries

    def _spell(self, entries: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the characters of the words of new entries."""
        n, total = int(entries[-1]) + 1, self.written + int(sizes.sum())
        self.spelt, self.length, self.letters = _grown(self.spelt, n), _grown(self.length, n), _grown(self.letters, total)
        before = np.cumsum(sizes) - sizes
        self.spelt[entries], self.length[entries] = self.written + before, sizes
        self.letters[self.written : total] = codes[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
        self.written = total

    def _mistaken(self, found: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, positions: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Which of the short words are others than those held that were found for them."""
        wrong = short & (self.length[found] != sizes)
        places = np.repeat(self.spelt[found] - starts, sizes)
        places += positions
        # What stands for a long word here is of no interest.
        differ = np.flatnonzero(self.letters.take(places, mode="clip") != codes)
        if len(differ):
            wrong[np.searchsorted(starts, differ, "right") - 1] = True
            wrong &= short
        return np.flatnonzero(wrong)

    def entries(self, text: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The entry of each word of a text that is cut at ``starts``; ``codes`` are its code points.  Entries hold until the next call."""
        self.words, self.filled = self.kept
        if len(self.pool) > 4 * max(self.room, self.filled):  # what a very long word needed
            self.pool = self.pool[: self.filled].copy()
        if self.words > self.limit or self.filled > self.room:
            self.forget()
        sizes = np.diff(starts, append=len(codes))
        positions = np.arange(len(codes))
        within = np.minimum(positions - np.repeat(starts, sizes), self.longest)
        hashes = np.add.reduceat((codes + np.uint32(1)).astype(np.uint64) * self.powers[within], starts) * _ODD ^ sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        found = self.table.get(hashes)
        long_ = sizes > self.longest
        new = np.flatnonzero((found < 0) & ~long_)

        def computed(at: np.ndarray) -> np.ndarray:
            return self._add(self.compute([text[a : a + n] for a, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]))

        if len(new):
            distinct, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            added = computed(at)
            self._spell(added, codes, starts[at], sizes[at])
            self.table.put(distinct, added)
            found[new] = added[back]
        self.kept = (self.words, self.filled)
        found[long_] = 0
        wrong = self._mistaken(found, codes, starts, sizes, positions, ~long_)
        passing = np.concatenate((np.flatnonzero(long_), wrong))
        if len(passing):
            found[passing] = computed(passing)
        return found

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The sequences of entries, one after another."""
        sizes = self.count[entries]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.pool[np.repeat(self.first[entries] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def document_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive ``starts`` (one more for the end)."""
    run = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return run[starts[1:]] - run[starts[:-1]]
