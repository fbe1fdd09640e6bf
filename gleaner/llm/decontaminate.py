"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are normalised to words (A-Z lower-cased; digits, a-z
and everything beyond ASCII are word characters) joined by one space.  The
patterns are the items' windows: 13 consecutive words, or the whole item if it
is shorter.  The search hashes the block of bytes that ends at a position; a
shift table tells how far the next possible occurrence is, so most positions
are never looked at; where the shift is 0, the hash selects a bucket of
patterns, and bytes are compared directly.  Many cursors, one per piece of
text, advance together as numpy vectors.

Patterns fall into classes by length, each with its own tables, so that one
short item does not shorten the shifts of all.  Benchmark items are dealt into
blocks of about :data:`BLOCK_BYTES`; the tables of each block are built once, by
a Spark task, and written to shared storage.  Whatever their number, blocks are
data and not plan: one Python stage reads the texts, in groups of
:data:`GROUP_BYTES` where there are several blocks, and takes each group through
the blocks one after another, of which it holds :data:`CACHED_BYTES` at most.

Cases: null texts and items have no words; items without words or without id
are no patterns; repeated items count once; the hits of overlapping windows are
counted once per document word; empty tables give no hits or no rows.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .workspace import AtomicFile, fresh, read_bytes, stored

WINDOW = 13
#: Benchmark text in one block.
BLOCK_BYTES = 2 << 20
#: Bytes of built blocks that a worker keeps, at least one.
CACHED_BYTES = 256 << 20
#: Bytes of text that go through all blocks together.
GROUP_BYTES = 32 << 20
#: Bytes of text that one cursor searches.
PIECE = 2048

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_RUNS = re.compile(rb" {2,}")


def words(text: str) -> list[bytes]:
    """The words of a text, normalised."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def normalised(text: str) -> bytes:
    """The words of a text with one space before, between and after them; two spaces if there is none."""
    spread = b" " + text.encode("utf-8", "surrogatepass").translate(_LOWER) + b" "
    return _RUNS.sub(b" ", spread) if not spread.isspace() else b"  "


class WuManber:
    """Search for byte patterns in classes of similar length."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.classes = []
        by_class: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            by_class.setdefault(min(len(p).bit_length(), 6), []).append(i)
        for members in by_class.values():
            self.classes.append(_LengthClass(patterns, members))

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Start and pattern index of every occurrence."""
        if not text:
            return
        view = np.ndarray((len(text),), "<u8", buffer=text + bytes(8), strides=(1,))
        for group in self.classes:
            yield from group.find(text, view)


class _LengthClass:
    def __init__(self, patterns: list[bytes], members: list[int]):
        self.patterns = patterns
        self.least = least = min(len(patterns[i]) for i in members)
        self.block = block = min(8, max(1, least // 2))
        self.mask = np.uint64((1 << 8 * block) - 1)
        blocks = len(members) * (least - block + 1)
        self.bits = min(max(blocks.bit_length() + 4, 12), 22)
        self.shifts = np.full(1 << self.bits, least - block + 1, np.int32)
        heads = b"".join(patterns[i][:least] for i in members)
        view = np.ndarray((len(heads),), "<u8", buffer=heads + bytes(8), strides=(1,))
        firsts = np.arange(len(members), dtype=np.int64) * least
        for offset in range(least - block + 1):
            np.minimum.at(self.shifts, self.hash(view[firsts + offset]), least - block - offset)
        last = self.hash(view[firsts + least - block])
        order = np.argsort(last, kind="stable")
        self.bucket_keys = last[order]
        self.bucket_members = np.asarray(members)[order]

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        mixed = (blocks & self.mask) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: bytes, view: np.ndarray) -> Iterator[tuple[int, int]]:
        block, least = self.block, self.least
        # A position is where the block begins whose end is the end of a pattern's first `least` bytes.
        begin = least - block
        stops = np.arange(begin, len(text) - block + 1, PIECE)
        at = stops.copy()
        stops = np.minimum(stops + PIECE, len(text) - block + 1)
        found = []
        while len(at):
            shift = self.shifts[self.hash(view[at])]
            zero = shift == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(shift, 1)
            going = at < stops
            at, stops = at[going], stops[going]
        if not found:
            return
        hits = np.concatenate(found)
        keys = self.hash(view[hits])
        low = np.searchsorted(self.bucket_keys, keys, "left")
        high = np.searchsorted(self.bucket_keys, keys, "right")
        patterns, members = self.patterns, self.bucket_members
        for position, a, b in zip((hits - begin).tolist(), low.tolist(), high.tolist(), strict=True):
            for m in members[a:b].tolist():
                if text.startswith(patterns[m], position):
                    yield position, m


class Matcher:
    """Windows of one block of items, and what they hit in texts."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", set()).add(item)
        patterns = list(owners)
        self.sizes = [p.count(b" ") - 1 for p in patterns]
        self.owners = [tuple(owners[p]) for p in patterns]
        self.search = WuManber(patterns) if patterns else None

    def scan(self, texts: list[str]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: number of words, which of them are hit (sorted indices), items with occurring windows."""
        piece = Piece(texts)
        self.search_in(piece)
        return piece.results()

    def search_in(self, piece: Piece) -> None:
        """Add to a piece what this block hits in it."""
        found = list(self.search.find(piece.joined)) if self.search else []
        if not found:
            return
        starts, which = (np.array(x, np.int64) for x in zip(*found, strict=True))
        owner = np.searchsorted(piece.ends, starts)
        word = np.searchsorted(piece.spaces, starts) - piece.first_space[owner]
        size = np.asarray(self.sizes)[which]
        for i in np.unique(owner).tolist():
            own = owner == i
            change = np.zeros(piece.counts[i] + 1, np.int64)
            np.add.at(change, word[own], 1)
            np.add.at(change, word[own] + size[own], -1)
            piece.add(i, np.flatnonzero(np.cumsum(change[:-1])), set().union(*(self.owners[k] for k in set(which[own].tolist()))))


class Piece:
    """Some texts as normalised bytes, and what has been hit in them."""

    def __init__(self, texts: list[str]):
        parts = [normalised(t) for t in texts]
        self.counts = np.array([p.count(b" ") - 1 if len(p) > 2 else 0 for p in parts], np.int64)
        self.joined = b"\0".join(parts)
        self.hit: dict[int, np.ndarray] = {}
        self.items: dict[int, set[str]] = {}

    # Every normalised text has one space more than words and one byte 0 after it.
    @functools.cached_property
    def ends(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 0)

    @functools.cached_property
    def spaces(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)

    @functools.cached_property
    def first_space(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.where(self.counts, self.counts + 1, 2))))

    def add(self, i: int, hit: np.ndarray, items: set[str]) -> None:
        self.hit[i] = np.union1d(self.hit[i], hit) if i in self.hit else hit
        self.items.setdefault(i, set()).update(items)

    def results(self) -> list[tuple[int, np.ndarray, set[str]]]:
        none = np.zeros(0, np.int64)
        return [(n, self.hit.get(i, none), self.items.get(i, set())) for i, n in enumerate(self.counts.tolist())]


def write_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """Build the tables of all blocks in Spark tasks.  Gives the paths of their files: one for each ``block_bytes`` of distinct items."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    if not n:
        return []
    folder = fresh(spark, "benchmark")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        number, paths = None, []

        def close() -> None:
            file = AtomicFile(f"{folder}/block-{number:06d}")
            file.write(pickle.dumps(Matcher(held, window), pickle.HIGHEST_PROTOCOL))
            file.close()
            paths.append(file.uri)
            held.clear()

        for batch in batches:
            for k, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and k != number:
                    close()
                number = k
                held.append((item, text))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    # An item longer than a block makes its block longer; others are dealt evenly by a hash.
    dealt = rows.select(F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block"), "item", "text").repartition(int(min(n, 10_000)), "block").sortWithinPartitions("block")
    return sorted(r[0] for r in stored(dealt.mapInArrow(build, "path string"), "benchmark-blocks").collect())


_BLOCKS: OrderedDict[str, tuple[Matcher, int]] = OrderedDict()


def _block(path: str) -> Matcher:
    """A built block, from the worker's cache or from shared storage."""
    if path not in _BLOCKS:
        raw = read_bytes(path)
        # What a built block holds in memory is several times its file.
        while _BLOCKS and sum(n for _, n in _BLOCKS.values()) + 4 * len(raw) > CACHED_BYTES:
            _BLOCKS.popitem(last=False)
        _BLOCKS[path] = pickle.loads(raw), 4 * len(raw)
    _BLOCKS.move_to_end(path)
    return _BLOCKS[path][0]


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Keys with n_words, n_hit, n_items, items (sorted as strings), contaminated (5 % of the words hit, at least one)."""
    df = documents.select(*keys, F.col(text).cast("string").alias("__text"))
    paths = write_blocks(benchmark, window, block_bytes)
    head = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + ", " * bool(keys)
    names, kinds = ["n_words", "n_hit", "n_items", "items"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], Piece]]:
        for batch in batches:
            for part in slices(batch, "__text"):
                yield [part.column(k) for k in keys], Piece(["" if t is None else t for t in part.column("__text").to_pylist()])

    def searched(group: list[tuple[list[pa.Array], Piece]]) -> Iterator[pa.RecordBatch]:
        for path in paths:
            matcher = _block(path)
            for _, piece in group:
                matcher.search_in(piece)
        for columns, piece in group:
            rows = []
            for n, hit, found in piece.results():
                listed = sorted(found, key=lambda s: s.encode())
                rows.append((n, len(hit), len(listed), listed))
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block is held all the time, so pieces need not wait for others.
        limit = GROUP_BYTES if len(paths) > 1 else 1
        group: list[tuple[list[pa.Array], Piece]] = []
        size = 0
        for columns, piece in pieces(batches):
            group.append((columns, piece))
            size += len(piece.joined)
            if size >= limit:
                yield from searched(group)
                group, size = [], 0
        if group:
            yield from searched(group)

    found = df.mapInArrow(run, head + "n_words long, n_hit long, n_items long, items array<string>")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
