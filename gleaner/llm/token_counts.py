"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is merged by the vocabulary's own rules; those
that come out as the one token they are, are *proven*: a pre-token that equals
one of them counts 1 by a lookup.  Only the other pre-tokens are merged.

Cases: a null or empty text has 0 tokens; a special string inside a text is one
token, as the library treats it by default; very long texts are counted whole,
in sections that end between pre-tokens, so that memory grows with the longest
pre-token only (merging is n log n); repeated rows give repeated results; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame

from .arrow import per_text
from .bpe import NEVER, merge
from .pretoken import Splitter, byte_symbols, describe
from .tables import WordMemory, document_sums, groups_by_size


def proven_strings(vocabulary: dict[str, int], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Vocabulary strings (as text) that merge to exactly themselves, among those that are whole characters."""
    symbols = byte_symbols()
    value = {s: b for b, s in enumerate(symbols)}

    def rank(a: str, b: str) -> float:
        return ranks.get((a, b), NEVER)

    found = []
    for token in vocabulary:
        if any(c not in value for c in token) or merge(list(token), rank) != [token]:
            continue
        try:
            found.append(bytes(value[c] for c in token).decode())
        except UnicodeDecodeError:
            continue
    return found


def prepare(path: str) -> dict:
    """Tables for :class:`TokenCounter`, built once on the driver; their size is bounded by the vocabulary."""
    spec = describe(path)
    model = json.loads(spec["json"])["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {p: i for i, p in enumerate(pairs)}
    return spec | {"ranks": ranks, "proven": proven_strings(model["vocab"], ranks)}


class TokenCounter:
    def __init__(self, tables: dict):
        self.splitter, self.ranks, self.symbols = Splitter(tables), tables["ranks"], byte_symbols()
        self.proven = frozenset(tables["proven"])
        # A word's "sequence" is the one number of its tokens.
        self.memory = WordMemory(lambda words: [np.array([self.tokens(w)]) for w in words], "<i8")

    def rank(self, a: str, b: str) -> float:
        return self.ranks.get((a, b), NEVER)

    def tokens(self, word: str) -> int:
        """Tokens of a pre-token: 1 if it is proven, else what merging gives."""
        return 1 if word in self.proven else len(merge([self.symbols[b] for b in word.encode()], self.rank))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        sections, firsts, marks = self.splitter.sections(texts)
        out = np.zeros(len(sections), np.int64)
        for a, b in groups_by_size(sections):
            text, codes, starts, words = self.splitter.split(sections[a:b])
            if len(starts):
                out[a:b] = document_sums(self.memory.gather(self.memory.entries(text, codes, starts)), words)
        for section, _ in marks:
            out[section] += 1
        return document_sums(out, firsts)


_LOADED: dict[str, TokenCounter] = {}


def token_counts(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """Keys with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    tables = df.sparkSession.sparkContext.broadcast(prepare(path))

    def make():
        if path not in _LOADED:
            _LOADED[path] = TokenCounter(tables.value)
        counter = _LOADED[path]

        def rows(texts: list[str]) -> list[tuple]:
            return [(len(x.encode()), n, n > limit) for x, n in zip(texts, counter.count(texts).tolist(), strict=True)]

        return rows

    return per_text(df, list(keys), text, "n_bytes long, n_tokens long, over_limit boolean", make)
