"""HTML extraction by a recurrent block labeller.

A bidirectional LSTM in numpy reads the leaf blocks of a page in order.  Each
block is a vector of its hashed tag path (tags, classes, ids), its hashed words
and a few measures; the two directions give every decision the context of the
whole page.  Blocks labelled as main text are joined by line ends.

The weights in ``block_labeller.npz`` are made by ``python -m
gleaner.llm.train_block_labeller`` from generated pages and are about 100 KB.

Cases: a null or empty page, or one without main text, has an empty text; very
long pages are read whole (memory grows with one page's blocks); broken markup
is read leniently; repeated rows are repeated; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import io
import re
import zlib
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame

from .arrow import per_text
from .html_blocks import Block, blocks

PATH_DIMS, LEAF_DIMS, WORD_DIMS, MEASURES = 48, 12, 32, 8
WIDTH = PATH_DIMS + LEAF_DIMS + WORD_DIMS + MEASURES
HIDDEN = 24
#: Blocks, padding included, that are labelled at a time.
CELLS = 40_000

_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hash(token: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % dims, 1.0 if h >> 16 & 1 else -1.0


@functools.lru_cache(maxsize=50_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags, classes and ids of a tag path, and the hashed leaf tag."""
    out = np.zeros(PATH_DIMS + LEAF_DIMS, np.float32)
    tokens = 0
    for element in path:
        tag, _, names = element.partition(" ")
        if tag in ("html", "body"):
            continue
        for token in [f"<{tag}>", *(p.lower() for p in _NAME_PARTS.findall(names))]:
            at, sign = _hash(token, PATH_DIMS)
            out[at] += sign
            tokens += 1
    if tokens:
        out[:PATH_DIMS] /= tokens**0.5
    leaf = path[-1].partition(" ")[0] if path else ""
    out[PATH_DIMS + _hash(leaf, LEAF_DIMS)[0]] = 1.0
    return out


class _Words(dict):
    """Dimension and sign of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        at, sign = _hash(word, WORD_DIMS)
        self[word] = found = at + (WORD_DIMS if sign < 0 else 0)
        return found


_WORDS = _Words()


def vectors(page: list[Block]) -> np.ndarray:
    """A row for each block of a page."""
    out = np.empty((len(page), WIDTH), np.float32)
    n = len(page)
    for i, b in enumerate(page):
        text = b.text
        split = text.lower().split()
        counts = np.bincount([_WORDS[w] for w in split], minlength=2 * WORD_DIMS)
        out[i, : PATH_DIMS + LEAF_DIMS] = path_vector(b.path)
        out[i, PATH_DIMS + LEAF_DIMS : -MEASURES] = (counts[:WORD_DIMS] - counts[WORD_DIMS:]) / len(split) ** 0.5
        size = len(text)
        stops = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?")
        out[i, -MEASURES:] = (np.log1p(size) / 8, np.log1p(len(split)) / 6, b.links / size, stops / len(split), text.count(",") / len(split), i / n, (n - 1 - i) / n, float(text[0] in "©&"))
    return out


class Labeller:
    """A bidirectional LSTM with one output a block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def start(cls, seed: int = 7) -> Labeller:
        """Random weights, for training."""
        r = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"x{d}"] = r.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN))
            w[f"h{d}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["out"] = r.normal(0, 0.1, 2 * HIDDEN)
        w["bias"] = np.zeros(1)
        return cls(w)

    def run(self, x: np.ndarray, live: np.ndarray, direction: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, page, unit) of one direction.  ``live`` is 0 for padding, where the state stands still."""
        steps, pages, _ = x.shape
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        projected = (x.reshape(steps * pages, WIDTH) @ self.w[f"x{direction}"] + self.w[f"c{direction}"]).reshape(steps, pages, 4 * HIDDEN)
        for t in range(steps) if direction == "f" else range(steps - 1, -1, -1):
            z = projected[t] + h @ self.w[f"h{direction}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            m = live[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out

    def label(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probability that a block is main text, (time, page)."""
        z = self.run(x, live, "f") @ self.w["out"][:HIDDEN] + self.run(x, live, "b") @ self.w["out"][HIDDEN:] + self.w["bias"]
        return 1 / (1 + np.exp(-z))

    def label_pages(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities for pages of any lengths, those of similar length together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        group: list[int] = []

        def flush() -> None:
            if group:
                x, live = pad([pages[k] for k in group])
                p = self.label(x, live)
                for j, k in enumerate(group):
                    out[k] = p[: len(pages[k]), j]
                group.clear()

        for k in order:
            if len(pages[k]):
                if group and len(pages[k]) * (len(group) + 1) > CELLS:
                    flush()
                group.append(k)
        flush()
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages as one array (time, page, dimension), and which cells are blocks."""
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    live = np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], live[: len(p), j] = p, 1
    return x, live


def packaged() -> bytes:
    """The weights that come with the package."""
    return resources.files(__package__).joinpath("block_labeller.npz").read_bytes()


def load(raw: bytes) -> Labeller:
    with np.load(io.BytesIO(raw)) as parts:
        return Labeller({k: parts[k] for k in parts.files})


def extract(pages: list[str], labeller: Labeller) -> list[str]:
    """Main text of each page."""
    split = [blocks(p) for p in pages]
    labels = labeller.label_pages([vectors(s) for s in split])
    return ["\n".join(b.text for b, p in zip(s, l, strict=True) if p >= 0.5) for s, l in zip(split, labels, strict=True)]


def main_text(pages: DataFrame, weights: bytes | None = None, page: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Keys with text and n_chars (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(packaged() if weights is None else weights)

    def make():
        labeller = load(shared.value)
        return lambda texts: [(t, len(t)) for t in extract(texts, labeller)]

    return per_text(pages, list(keys), page, "text string, n_chars long", make)
