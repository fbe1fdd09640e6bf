"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counts and ratios of whole texts (characters by class,
overall and by eighths of the text; words; repeated words, pairs and lines).
The trees are fitted on the driver from the statistics of a bounded sample of
labelled documents and scored in batches as flat arrays.  Long texts are gone
through in steps of :data:`STEP` bytes; of their words 8 bytes each are held.

Cases: a null or empty text has all statistics 0 and gets a score like any
other; without labels, or with one only, every score is the same (0.5 without
any); repeated rows are repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices, text_buffer
from .boosting import Forest, fit

#: Labelled documents from which a model is fitted at most.
SAMPLE = 20_000
PARTS = 8
#: Bytes of text that are looked at in one step.
STEP = 2 << 20
_BLANK = b" \t\n\r\x0b\x0c"


def _classes() -> np.ndarray:
    """Class of each byte: other control, lower, upper, digit, blank, line end, stop, exclamation, mark, bar, quote, lead byte, later byte."""
    out = np.zeros(256, np.int64)
    out[0x80:0xC0], out[0xC0:] = 12, 11
    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "#*%&$@^~+=<>", "|\\/_{}[]", "'\"()-`")
    for k, group in enumerate(groups, 1):
        for c in group:
            out[ord(c)] = k
    return out


CLASSES = _classes()
N_CLASSES = 13


def _word_statistics(raw: bytes) -> list[float]:
    w = raw.split()
    n = len(w)
    if not n:
        return [0.0] * 12
    lines = [x for x in raw.split(b"\n") if x]
    sizes = list(map(len, w))
    counts = Counter(w)
    pairs = len(set(zip(w, w[1:], strict=False)))
    seen_lines = len(set(lines))
    return [
        n,
        sum(sizes) / n,
        max(sizes),
        len(counts) / n,
        len(counts) / n**0.5,
        max(counts.values()) / n,
        sum(map(eq, w, w[1:])) / n,
        pairs / n,
        len(lines),
        n / max(len(lines), 1),
        seen_lines / max(len(lines), 1),
        max(map(len, lines), default=0),
    ]


def _cuts(data: np.ndarray, marks: bytes, step: int) -> list[int]:
    """Positions about ``step`` bytes apart that each follow one of the ``marks``, and the ends."""
    out, at = [0], 0
    is_mark = np.zeros(256, bool)
    is_mark[list(marks)] = True
    while at + step < len(data):
        look = at + step
        while look < len(data):
            places = np.flatnonzero(is_mark[data[look : look + step]])
            if len(places):
                break
            look += step
        at = look + int(places[0]) + 1 if look < len(data) else len(data)
        out.append(at)
    return out if out[-1] == len(data) else [*out, len(data)]


def _long_word_statistics(data: np.ndarray, step: int = STEP) -> list[float]:
    """The same for a long text, in steps: words and lines are held as 64-bit hashes, which in sorted order tell how many differ."""
    digest = xxhash.xxh64_intdigest
    hashes: list[np.ndarray] = []
    total = longest = 0
    edges = _cuts(data, _BLANK, step)
    for a, b in zip(edges, edges[1:], strict=False):
        w = data[a:b].tobytes().split()
        hashes.append(np.fromiter(map(digest, w), np.uint64, len(w)))
        total, longest = total + sum(map(len, w)), max(longest, max(map(len, w), default=0))
    h = np.concatenate([np.zeros(0, np.uint64), *hashes])
    hashes.clear()
    n = len(h)
    if not n:
        return [0.0] * 12
    same = int(np.count_nonzero(h[1:] == h[:-1]))
    pairs = _distinct(h[1:] ^ (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    distinct = _distinct(h)  # sorts in place
    runs = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    most = int(np.diff(runs, append=n).max())
    lines: list[np.ndarray] = []
    widest = 0
    edges = _cuts(data, b"\n", step)
    for a, b in zip(edges, edges[1:], strict=False):
        x = [y for y in data[a:b].tobytes().split(b"\n") if y]
        lines.append(np.fromiter(map(digest, x), np.uint64, len(x)))
        widest = max(widest, max(map(len, x), default=0))
    own = np.concatenate([np.zeros(0, np.uint64), *lines])
    n_lines = max(len(own), 1)
    return [n, total / n, longest, distinct / n, distinct / n**0.5, most / n, same / n, pairs / n, len(own), n / n_lines, _distinct(own) / n_lines, widest]


def _distinct(hashes: np.ndarray) -> int:
    """How many values differ; sorts them in place."""
    hashes.sort()
    return int(np.count_nonzero(hashes[1:] != hashes[:-1])) + min(len(hashes), 1)


def _class_counts(data: np.ndarray, starts: np.ndarray, step: int = STEP) -> np.ndarray:
    """Bytes of each class in each part of each text, (text, part, class)."""
    n, sizes = len(starts) - 1, np.diff(starts)
    counts = np.zeros(n * PARTS * N_CLASSES, np.int64)
    for begin in range(0, len(data), step):
        end = min(begin + step, len(data))
        rows = np.arange(np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end, "left"))
        here = np.minimum(starts[rows + 1], end) - np.maximum(starts[rows], begin)
        part = (np.arange(begin, end) - np.repeat(starts[rows], here)) * PARTS // np.repeat(sizes[rows], here)
        counts += np.bincount((np.repeat(rows, here) * PARTS + part) * N_CLASSES + CLASSES[data[begin:end]], minlength=len(counts))
    return counts.reshape(n, PARTS, N_CLASSES)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text of a string column."""
    data, starts = text_buffer(column)
    n, sizes = len(column), np.diff(starts)
    counts = _class_counts(data, starts).astype(float)
    whole = counts.sum(axis=1)
    total = np.maximum(sizes, 1)[:, None]
    ratio = whole / total
    letters = np.maximum(counts[:, :, 1] + counts[:, :, 2] + counts[:, :, 11], 1)
    blanks = np.maximum(counts[:, :, 4] + counts[:, :, 5], 1)
    upper, marks, bars, shouts = counts[:, :, 2] / letters, counts[:, :, 8] / blanks, counts[:, :, 9] / blanks, counts[:, :, 7] / blanks
    extremes = [f(x, axis=1) for x in (upper, marks, bars, shouts) for f in (np.max, np.mean)]
    spans = zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
    words = np.array([_word_statistics(data[a:b].tobytes()) if b - a <= STEP else _long_word_statistics(data[a:b]) for a, b in spans]).reshape(n, 12)
    return np.column_stack([np.log1p(sizes), ratio, *extremes, words])


def _features(df: DataFrame) -> DataFrame:
    """label and x, the statistics of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                x = statistics(piece.column("text"))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("label"), rows], names=["label", "x"])

    return df.select("label", "text").mapInArrow(run, "label int, x array<double>")


def fit_forest(sample: DataFrame, bound: int = SAMPLE) -> Forest:
    """Fit to (text, label) rows; only their statistics, of at most ``bound`` rows, reach the driver."""
    rows = sorted((tuple(r["x"]), r["label"]) for r in _features(sample).limit(bound).collect())
    if not rows:
        return fit(np.zeros((0, 1)), np.zeros(0))
    return fit(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float))


def score(df: DataFrame, forest: Forest, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score, the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    kept = df.select(*keep)
    names = [f"__{i}" for i in range(len(kept.columns))]
    columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(keep, names, strict=True)]
    # A text that is kept anyway is not sent twice.
    own = names[keep.index(text)] if all(isinstance(c, str) for c in keep) and text in keep else "__text"
    rows = df.select(*columns, *([F.col(text).cast("string").alias("__text")] if own == "__text" else []))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "__text") + ", __score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, own):
                scores = shared.value.score(statistics(piece.column(own)))
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + [pa.array(scores)], names=[*names, "__score"])

    scored = rows.mapInArrow(run, schema)
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, kept.columns, strict=True)], F.col("__score").alias("score"))
