"""The pre-tokens of a byte-level BPE tokenizer, found as its library finds them.

A table of character classes is made once on the driver: by the ``regex``
module, whose Unicode tables may be newer than the library's, and for characters
about which the two differ by probing the library.  With it the pattern is
evaluated on whole batches of texts by numpy.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

from .tables import SECTION, code_points, cut_text

#: Fixed value: the pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


def doubtful_characters(tokenizer: Tokenizer) -> str:
    """Characters that the ``regex`` module classes otherwise than the library does."""
    known = regex.compile(r"[\p{L}\p{N}]")
    suspects = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and known.match(c)]
    pattern, split = regex.compile(PATTERN), tokenizer.pre_tokenizer.pre_tokenize_str
    text = "".join(f"a{c}1{c}\n" for c in suspects)
    ours = {m.span() for m in pattern.finditer(text)}
    theirs = {span for _, span in split(text)}
    return "".join(sorted({c for start, end in ours ^ theirs for c in text[start:end] if ord(c) >= 0x80}))


def character_classes(tokenizer: Tokenizer) -> bytes:
    """A byte for each code point: 0 white space, 1 letter, 2 number, 3 other, as the library sees them."""
    out = np.full(0x110000, 3, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\s", 0), (r"\p{L}", 1), (r"\p{N}", 2)):
        out[code_points("".join(regex.findall(pattern, everything)))] = kind
    for c in doubtful_characters(tokenizer):
        after = [len(tokenizer.pre_tokenizer.pre_tokenize_str(p + c)) == 1 for p in "a1!"]
        out[ord(c)] = after.index(True) + 1 if any(after) else 0
    return out.tobytes()


def word_starts(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts that stand one after another.

    ``codes`` are the code points, ``first`` the positions where texts begin.
    It is the pattern spelled out: runs of one class take one blank before them;
    white space leaves its last character to what follows; some endings after
    an apostrophe stand alone.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[codes]
    space = kind == 0
    begin = np.zeros(n, bool)
    begin[first] = True
    change = begin.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    inner = np.flatnonzero(change & ~space & ~begin)
    inner = inner[space[inner - 1]]  # words after white space of the same text
    start[inner[codes[inner - 1] == 32]] = False
    start[inner - 1] = True
    quotes = np.flatnonzero((codes == 39) & start)
    if len(quotes):
        ends = np.append(first, n)[np.searchsorted(first, quotes, "right")]
        one = np.where(quotes + 1 < ends, codes[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 < ends, codes[np.minimum(quotes + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quotes[short | long_] + 1] = False
        stops = np.concatenate((quotes[short] + 2, quotes[long_] + 3))
        start[stops[stops < n]] = True
    return np.flatnonzero(start)


class Splitter:
    """Cuts texts into pre-tokens and special strings.  ``spec`` is what :func:`describe` gives."""

    def __init__(self, spec: dict):
        self.classes = np.frombuffer(spec["classes"], np.uint8)
        self.special = spec["special"]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _borders(self, codes: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin whatever else the text holds: at white space after something else, and where a run of letters or numbers ends."""
        kind = self.classes[codes]
        a, b = kind[:-1], kind[1:]
        return np.flatnonzero((b == 0) & (a != 0) | ((a == 1) | (a == 2)) & (a != b)) + 1

    def sections(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[tuple[int, str]]]:
        """All texts cut at special strings, and long ones at borders of pre-tokens: the sections between, the first section of each text (one more for the end), and the special string after a section."""
        if all(len(t) <= SECTION for t in texts) and (self.cut is None or not any(self.cut.search(t) for t in texts)):
            return texts, np.arange(len(texts) + 1), []
        out: list[str] = []
        firsts, marks = [], []
        for t in texts:
            firsts.append(len(out))
            at = 0
            for mark in self.cut.finditer(t) if self.cut else ():
                out += cut_text(t[at : mark.start()], self._borders)
                marks.append((len(out) - 1, mark[0]))
                at = mark.end()
            out += cut_text(t[at:] if at else t, self._borders)
        return out, np.array([*firsts, len(out)]), marks

    def split(self, sections: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The sections joined, their code points, where pre-tokens begin, and the first pre-token of each section (one more for the end)."""
        text = "".join(sections)
        codes = code_points(text)
        ends = np.cumsum(np.fromiter(map(len, sections), np.int64, len(sections)))
        bounds = np.concatenate(([0], ends)).astype(np.int64)
        firsts = np.unique(bounds[:-1][np.diff(bounds) > 0])
        starts = word_starts(codes, firsts, self.classes)
        return text, codes, starts, np.searchsorted(starts, bounds)


def describe(path: str) -> dict:
    """What executors need of a tokenizer file; its size is that of the vocabulary.

    Raises ValueError for a tokenizer that is not byte-level BPE with this
    pattern, as its pre-tokens would be others.
    """
    with open(path, encoding="utf-8") as file:
        source = file.read()
    spec = json.loads(source)
    step = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("only byte-level BPE without a normalizer is handled")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that strip or need word borders are not handled")
    return {"json": source, "classes": character_classes(Tokenizer.from_str(source)), "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}
