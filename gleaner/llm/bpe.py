"""Byte-pair merging by rank, shared by the tokenizer operators."""

from __future__ import annotations

import heapq
from collections.abc import Callable

NEVER = float("inf")


def merge(symbols: list[str], rank: Callable[[str, str], float]) -> list[str]:
    """Join adjacent symbols, lowest rank first and leftmost among equals, until no pair has a rank."""
    return _merge_long(symbols, rank) if len(symbols) > 64 else merge_until(symbols, rank, 1)


def merge_until(symbols: list[str], rank: Callable[[str, str], float], least: int) -> list[str]:
    """The same for short input, until ``least`` symbols are left."""
    parts = list(symbols)
    ranks = [rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
    while len(parts) > least and ranks:
        low = min(ranks)
        if low == NEVER:
            break
        i = ranks.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = rank(parts[i - 1], parts[i])
        if i < len(ranks):
            ranks[i] = rank(parts[i], parts[i + 1])
    return parts


def _merge_long(symbols: list[str], rank: Callable[[str, str], float]) -> list[str]:
    """The same with a heap and a linked list: n log n."""
    parts: list[str | None] = list(symbols)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) != NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i] = left + right
        parts[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := rank(parts[i], parts[after[i]])) != NEVER:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
        if before[i] >= 0:
            h = before[i]
            if (r := rank(parts[h], parts[i])) != NEVER:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]
