"""BERT-style tokenisation and pluggable embedding of chunks."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Embedder = Callable[[], Callable[[list[str]], np.ndarray]]


def basic_tokens(text: str) -> list[str]:
    """Lower-cased words without accents; punctuation stands alone."""
    out: list[str] = []
    word = ""
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn":
            continue
        if c.isspace() or kind.startswith("P") or (c.isascii() and not c.isalnum()):
            if word:
                out.append(word)
            word = ""
            if not c.isspace():
                out.append(c)
        else:
            word += c
    return [*out, word] if word else out


def wordpiece(word: str, vocabulary: dict[str, int], unknown: str = "[UNK]") -> list[str]:
    """The longest known pieces from the left; the whole word is unknown if one is missing."""
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                break
        else:
            return [unknown]
        out.append(piece)
        at = end
    return out


def ids(text: str, vocabulary: dict[str, int], most: int = 512) -> list[int]:
    """Ids between [CLS] and [SEP]; beyond ``most`` the text is cut at a whole word, as the model's input has no more room."""
    out = [vocabulary["[CLS]"]]
    for word in basic_tokens(text):
        pieces = [vocabulary[p] for p in wordpiece(word, vocabulary)]
        if len(out) + len(pieces) > most - 1:
            break
        out += pieces
    return [*out, vocabulary["[SEP]"]]


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked positions, scaled to length 1."""
    mean = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)


def hash_embedder(width: int = 768) -> Embedder:
    """Stands in for a model: a fixed random direction for each word, summed and scaled."""

    def make():
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width), np.float32)
            for i, t in enumerate(texts):
                for w in basic_tokens(t):
                    seed = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, seed % width] += 1.0 if seed >> 63 else -1.0
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        return embed

    return make


def embed_chunks(chunks: DataFrame, embedder: Embedder, text: str = "chunk_text", batch: int = 32) -> DataFrame:
    """Add a vector to each chunk; texts go to the embedder in small batches."""
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = embedder()
        for b in batches:
            texts = [t or "" for t in b.column(names.index(text)).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], names=[*names, "vector"])

    return chunks.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in chunks.dtypes] + ["vector array<float>"]))
