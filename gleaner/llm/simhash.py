"""SimHash near-duplicates, with pivot distance tables.

A document's fingerprint has, for each of 64 bits, the majority among the
XXH64 hashes of its word shingles.  Documents link if their fingerprints differ
in at most ``radius`` bits; components of links are the groups.

Equal fingerprints are one node.  The pivot table holds, once for each of them,
the Hamming distances to fixed reference fingerprints, a byte each; it is made
and stored with the distinct fingerprints and goes wherever they go.  By the
triangle inequality a pair within the radius differs by no more than the radius
in every coordinate.  So inside a bucket fingerprints are sorted by their first
coordinate, and each is paired only with those up to ``radius`` beyond it; a
pair whose maximum difference over the other coordinates is larger is discarded;
the fingerprints of the survivors are compared.

Distances of random fingerprints to a pivot lie within a few bits of 32, so by
pivots alone nearly all would be paired.  Buckets come from equal segments: of
radius + 2 segments of the bits, a pair within the radius has two equal ones, so
it meets in the bucket of those two.  A bucket with more than ``HOT``
fingerprints is not searched but split anew: by the same rule over the bits that
its members do not yet share.  Nothing is left out.  Links that join what a task
has already joined are not emitted.

Cases: a null or empty text has fingerprint 0 and links like any other; texts
of fewer words than a shingle are one shingle; a null doc_id ranks last
(component null only if nobody in it has an id); repeated rows are repeated in
the result; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import per_text
from .joins import join_unique
from .mphf import mix
from .workspace import stored

SEED = 42
RADIUS = 4
#: Fingerprints of a bucket that are compared in one task; more are split by further bits.
HOT = 1000
#: Distances are a byte each, eight to a column.
N_PIVOTS = 16
TABLE = [f"t{k}" for k in range(N_PIVOTS // 8)]
#: Fixed reference fingerprints.
PIVOTS = np.array([random.Random(i).getrandbits(64) for i in range(N_PIVOTS)], np.uint64)

_LANES = np.arange(8, dtype=np.int64) * 256
_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingles(text: str, size: int) -> list[bytes]:
    """Shingles of a text, repeats included: words between white space, A-Z lower-cased, joined by one space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def fingerprint(text: str, size: int = 4) -> int:
    """The fingerprint as an unsigned integer."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = list(itertools.accumulate(map(len, w), lambda a, n: a + 1 + n))
    digest = xxhash.xxh64_intdigest
    if len(w) <= size:
        hashes = [digest(joined, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends[: len(w) - size])]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8) + _LANES
    ones = np.einsum("lv,vb->lb", np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256), _BITS)
    return int(_POWERS[ones.ravel() * 2 > len(hashes)].sum())


def fingerprints(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), size: int = 4) -> DataFrame:
    """Keys with fp, the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [(f - (f >> 63 << 64),) for f in (fingerprint(t, size) for t in texts)]

    return per_text(df, list(keys), text, "fp long", make)


def segments(mask: int, parts: int) -> list[int]:
    """Masks of ``parts`` segments of about equal size that cover the bits of ``mask``."""
    bits = [i for i in range(64) if mask >> i & 1]
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def bucket_masks(mask: int, radius: int) -> list[int]:
    """Masks of two segments each: a pair within the radius agrees on at least one of them."""
    return [a | b for a, b in itertools.combinations(segments(mask, radius + 2), 2)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to the pivots, a row each."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :])


class PivotTable:
    """The test on pairs by their distances to the pivots; ``distances`` are computed only if none are given."""

    def __init__(self, fps: np.ndarray, distances: np.ndarray | None = None):
        self.fps = fps
        self.distances = (pivot_table(fps) if distances is None else distances).astype(np.int8)
        self.looked = self.survived = 0

    def close(self, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
        """Which of the pairs (i, j) are within the radius.  Coordinates are compared a few at a time, then the survivors themselves."""
        left = np.arange(len(i))
        self.looked += len(i)
        for k in range(0, N_PIVOTS, 4):
            if not len(left):
                return left
            gap = np.abs(self.distances[i[left], k : k + 4] - self.distances[j[left], k : k + 4]).max(axis=1)
            left = left[gap <= radius]
        self.survived += len(left)
        return left[np.bitwise_count(self.fps[i[left]] ^ self.fps[j[left]]) <= radius]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[k] with b[k] for all k."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        parent = _roots(parent)


def link_sorted(groups: np.ndarray, table: PivotTable, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``groups`` that connect all that lies within the radius, without most of the redundant ones.

    Within a run rows are sorted by their first coordinate, so each is paired with those after it until the coordinate is too far.
    """
    fps, coordinate = table.fps, table.distances[:, 0]
    n = len(fps)
    parent = np.arange(n)
    run = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.repeat(np.r_[run[1:], n], np.diff(np.r_[run, n])) if n else run
    left, right = [], []
    alive, lag = np.arange(n), 1
    while len(alive):
        alive = alive[alive + lag < ends[alive]]
        alive = alive[coordinate[alive + lag] - coordinate[alive] <= radius]
        i = alive[parent[alive] != parent[alive + lag]]
        found = i[table.close(i, i + lag, radius)]
        if len(found):
            left.append(fps[found])
            right.append(fps[found + lag])
            parent = _join(parent, found, found + lag)
        lag += 1
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate(left), np.concatenate(right)


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns (bucket first) of sorted batches, in pieces that never cut a bucket."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= rows:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            g = columns[0]
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            if cut:
                yield [c[:cut] for c in columns]
            held, size = [[c[cut:] for c in columns]], len(g) - cut
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the pivot table to fingerprints."""
    for batch in batches:
        packed = pivot_table(batch.column("fp").to_numpy().view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(packed[:, k]) for k in range(len(TABLE)))], names=[*batch.schema.names, *TABLE])


def with_pivots(distinct: DataFrame) -> DataFrame:
    """Add the pivot table to a table of fingerprints ``fp``."""
    schema = ", ".join(f"`{n}` {t}" for n, t in distinct.dtypes)
    return distinct.mapInArrow(_tabled, schema + "".join(f", {t} long" for t in TABLE))


def _put(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint and its pivot table with every bucket that it falls into, and the bits that the members of that bucket need not share."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 20_000):
            fp, within, open_, *table = (c.slice(begin, 20_000).to_numpy().view(np.uint64) for c in batch.columns)
            out: list[tuple[np.ndarray, ...]] = []
            for mask in np.unique(open_).tolist():
                own = open_ == mask
                for m in bucket_masks(mask, radius):
                    bucket = mix(fp[own] & np.uint64(m), 0) ^ mix(within[own] ^ np.uint64(m), 1)
                    out.append((bucket, fp[own], np.full(len(bucket), mask & ~m, np.uint64), *(t[own] for t in table)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out, strict=True)], names=["bucket", "fp", "open", *TABLE])


def near_pairs(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Stored links (a, b) of distinct fingerprints ``fp`` that connect everything within the radius.  A pivot table that comes with them is used."""
    hot = max(hot, 1 << (radius + 2))  # so that a crowded bucket always has bits left for every segment
    linked: DataFrame | None = None
    tabled = distinct if set(TABLE) <= set(distinct.columns) else with_pivots(distinct)
    level = tabled.select("fp", F.lit(0).cast("long").alias("within"), F.lit(-1).cast("long").alias("open"), *TABLE)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _put(batches, radius)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, fps, *table in _whole_groups(batches):
            distances = np.stack(table, axis=1).view(np.uint8)
            order = np.lexsort((distances[:, 0], groups))
            a, b = link_sorted(groups[order], PivotTable(fps.view(np.uint64)[order], distances[order]), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    while True:
        rows = stored(level.mapInArrow(put, "bucket long, fp long, open long" + "".join(f", {t} long" for t in TABLE)), "simhash-buckets")
        crowded = stored(rows.groupBy("bucket").count().where(F.col("count") > hot).select("bucket"), "simhash-crowded")
        done = crowded.isEmpty()
        few = rows if done else rows.join(crowded, "bucket", "left_anti")
        found = few.select("bucket", "fp", *TABLE).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(link, "a long, b long")
        found = stored(found.distinct(), "simhash-links")
        linked = found if linked is None else linked.unionByName(found)
        if done:
            return linked
        level = stored(rows.join(crowded, "bucket", "left_semi").select("fp", F.col("bucket").alias("within"), "open", *TABLE), "simhash-level")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a batch by stars around the least node of each of its components."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, where = np.unique(np.concatenate((a, b)), return_inverse=True)
        parent = _join(np.arange(len(nodes)), where[: len(a)], where[len(a) :])
        away = np.flatnonzero(parent != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[parent[away]])], names=["a", "b"])


def stars(links: DataFrame) -> DataFrame:
    """Stored (node, root) for every linked node but the roots, the least node of each component.

    Alternates two joins of links with the least neighbour of a node (large
    star, small star) until nothing changes; each round is a written table.
    """

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(links.mapInArrow(_local_stars, "a long, b long").distinct(), "simhash-stars")
    state = summary(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small.mapInArrow(_local_stars, "a long, b long").distinct(), "simhash-stars")
        before, state = state, summary(edges)
        if before == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(marked: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) with component_id, the least doc_id that links reach."""
    distinct = stored(with_pivots(marked.groupBy("fp").agg(F.min(key).alias("low"), F.count("*").alias("n"))), "simhash-distinct")
    forest = stars(near_pairs(distinct, radius))
    rooted = distinct.select("fp", "low", "n").join(forest.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "simhash-rooted")
    least = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size")), "simhash-least")
    labels = stored(join_unique(rooted.select("fp", "n", "root"), least, "root", "size").select("fp", "n", "component_id"), "simhash-labels")
    return join_unique(marked, labels, "fp", "n")


def near_duplicates(documents: DataFrame, text: str = "text", size: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    marked = stored(fingerprints(documents, text, ("doc_id",), size), "simhash")
    return components(marked, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
