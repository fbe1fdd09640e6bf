"""Sentences, semantic chunks and paragraph packing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dictionaries import STOP_WORDS

_STOP = frozenset(STOP_WORDS)
_NO_LETTER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class ChunkParams:
    least: int = 100
    most: int = 500
    window: int = 5
    threshold: float = 0.3
    #: False: a sentence ends at any . ! ? once it has three words, whatever follows.
    before_space: bool = True


def sentences(text: str) -> list[str]:
    """Sentences of three words and more; they end at . ! ? before a space, a quotation mark or the end."""
    flat = " ".join(text.split())
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])(?=[ \"'])", flat)) if len(s.split()) >= 3]


def sentences_by_words(text: str, least: int = 3) -> list[str]:
    """Sentences that end at any . ! ? once they have three words; a shorter rest is left out."""
    flat = " ".join(text.split())
    out: list[str] = []
    start = words = 0
    for m in re.finditer(r"[^.!?]*[.!?]|[^.!?]+$", flat):
        piece = m.group()
        # A piece that goes on without a space continues the word before it.
        joined = m.start() > start and flat[m.start() - 1] != " " and piece[0] != " "
        words += len(piece.split()) - joined
        if words >= least:
            out.append(flat[start : m.end()].strip())
            start, words = m.end(), 0
    return out


def terms(part: list[str]) -> Counter:
    """Frequencies of alphabetic words of three bytes and more without stop words."""
    w = (_NO_LETTER.sub("", x).lower() for s in part for x in s.split())
    return Counter(x for x in w if len(x.encode()) >= 3 and x not in _STOP)


def cosine(a: Counter, b: Counter) -> float:
    norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    return sum(n * b[t] for t, n in a.items()) / norm if norm else 0.0


def _move(window: Counter, new: Counter, old: Counter) -> None:
    window.update(new)
    for t, n in old.items():
        if window[t] == n:
            del window[t]
        else:
            window[t] -= n


def boundaries(parts: list[str], window: int, threshold: float) -> list[int]:
    """Where the similarity of the sentences before and after has a low local minimum."""
    each = [terms([p]) for p in parts]
    scores = []
    before, after = sum(each[:window], Counter()), sum(each[window : 2 * window], Counter())
    for g in range(window, len(parts) - window):
        scores.append(cosine(before, after))
        # Both windows move on by one sentence.
        _move(before, each[g], each[g - window])
        _move(after, each[g + window], each[g])
    return [window + i for i in range(1, len(scores) - 1) if scores[i] < threshold and scores[i] <= scores[i - 1] and scores[i] <= scores[i + 1]]


def merge_small(chunks: list[str], least: int) -> list[str]:
    """Chunks joined forward until each has enough words; what is left joins the last."""
    out: list[str] = []
    held = ""
    for c in chunks:
        held = f"{held} {c}" if held else c
        if len(held.split()) >= least:
            out.append(held)
            held = ""
    if held:
        out = [*out[:-1], f"{out[-1]} {held}"] if out else [held]
    return out


def fixed_windows(text: str, most: int) -> list[str]:
    """Windows of at most ``most`` words with an overlap of a tenth, 20 words at least."""
    w, step = text.split(), most - max(most // 10, 20)
    out, at = [], 0
    while at < len(w):
        out.append(" ".join(w[at : at + most]))
        if at + most >= len(w):
            break
        at += step
    return out


def semantic_chunks(text: str, p: ChunkParams = ChunkParams()) -> list[str]:
    """Chunks that end where the topic shifts; those under the least size are dropped."""
    parts = sentences(text) if p.before_space else sentences_by_words(text)
    if len(parts) <= 2 * p.window:
        whole = " ".join(parts)
        n = len(whole.split())
        return [] if n < p.least else [whole] if n <= p.most else fixed_windows(whole, p.most)
    cuts = [0, *boundaries(parts, p.window, p.threshold), len(parts)]
    merged = merge_small([" ".join(parts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], p.least)
    out: list[str] = []
    for c in merged:
        n = len(c.split())
        out += fixed_windows(c, p.most) if n > p.most else [c] if n >= p.least else []
    return out


def chunk_table(df: DataFrame, key: str = "doc_id", text: str = "text", params: ChunkParams = ChunkParams()) -> DataFrame:
    """key, chunk_index, chunk_text for every chunk of every document."""
    kept = df.select(key, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [semantic_chunks(t or "", params) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.string()))], names=[key, "chunks"])

    chunks = kept.mapInArrow(run, f"`{key}` {kept.dtypes[0][1]}, chunks array<string>")
    return chunks.select(key, F.posexplode("chunks").alias("chunk_index", "chunk_text"))


def pack_paragraphs(text: str, most: int, overlap: int) -> list[str]:
    """Paragraphs packed to at most ``most`` words; a new part begins with the last words of the paragraph before, and the rest joins the last part."""
    count = lambda s: sum(1 for w in s.split() if re.search("[A-Za-z]", w))
    out: list[str] = []
    held, before = "", ""
    for block in text.split("\n\n"):
        if held and count(held) + count(block) > most:
            out.append(held)
            tail = before if count(before) < overlap else " ".join(before.split()[-overlap:]) if overlap else ""
            held = f"{tail} {block}" if tail else block
        else:
            held = f"{held}\n\n{block}" if held else block
        before = block
    return [*out[:-1], f"{out[-1]} {held}"] if out and held else out or [held]


def split_long(text: str, most: int, overlap: int) -> list[str]:
    """Packed paragraphs of a text whose blank lines, white space on them included, are one blank line each; parts are trimmed, those of one character or none left out."""
    parts = pack_paragraphs(re.sub(r"\n\s+\n", "\n\n", text), most, overlap)
    return [p for p in map(str.strip, parts) if len(p) > 1]
