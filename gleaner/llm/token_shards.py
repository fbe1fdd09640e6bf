"""Token ids in binary shards with a minimal-perfect-hash index.

A shard is two files.  ``.ids`` has a header of 8 bytes (magic, bytes an id) and
then the raw ids of its documents, one after another.
``.idx`` has the documents' offsets, their keys in order, and for random access
a minimal perfect hash from key to a slot, which stores a fingerprint of the
key and the number of the document.  A lookup costs one hash, one comparison of
fingerprints and one read, whatever the size of the shard.

Documents are written in ascending key order: Spark's range partitions are
shards' key ranges, and the order inside is by sorting.  Ids are those of the
tokenizers library: it encodes each pre-token that a worker has not yet met,
and the ids of known ones are copied.

Cases: a null or empty text has the end id only; null keys come first; rows
that repeat a key follow one another, if need be over several shards, and a
lookup gives the first record of the shard with that key and how many there are;
an empty table gives no shards.  A key that many rows share is dealt to several
tasks by a hash of the text.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .arrow import slices
from .mphf import MinimalPerfectHash, mix
from .pretoken import Splitter, describe
from .tables import WordMemory, document_sums, groups_by_size
from .workspace import AtomicFile, fresh, open_input, read_bytes, stored

MAGIC = b"GLIDS1\0"
#: A shard is closed at so many documents or bytes of ids.
SHARD_DOCUMENTS, SHARD_BYTES = 500_000, 256 << 20
READ_IDS = 2 << 20
#: Words that the library encodes in one call.
CHUNK = 4000
_BLANK = re.compile(r"\s")


class IdEncoder:
    """Ids of whole texts as the library gives them, as raw bytes."""

    def __init__(self, spec: dict):
        self.splitter = Splitter(spec)
        self.library = Tokenizer.from_str(spec["json"])
        size = max(json.loads(spec["json"])["model"]["vocab"].values(), default=0)
        self.width = "<u2" if max(size, *spec["special"].values(), 0) < 1 << 16 else "<u4"
        self.special = {k: np.array([v], self.width).tobytes() for k, v in spec["special"].items()}
        self.memory = WordMemory(self._compute, self.width)
        gap = self.library.encode("\n", add_special_tokens=False).ids
        self.gap = gap[0] if len(gap) == 1 else None

    def _alone(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words without white space, but for a leading blank: joined by line ends they stay the pre-tokens that they are."""
        ids = np.array(self.library.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, self.width)
        cuts = np.flatnonzero(ids == self.gap)
        if self.gap is None or len(cuts) != len(words) - 1:
            return self._alone(words)
        starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(starts, ends, strict=True)]

    def _compute(self, words: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens, by the library."""
        plain, other = [], []
        for k, w in enumerate(words):
            (other if w.isspace() or _BLANK.search(w, 1) else plain).append(k)
        out: list[np.ndarray] = [None] * len(words)
        for i in range(0, len(plain), CHUNK):
            part = plain[i : i + CHUNK]
            for k, ids in zip(part, self._together([words[k] for k in part]), strict=True):
                out[k] = ids
        for k, ids in zip(other, self._alone([words[k] for k in other]), strict=True):
            out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as raw bytes."""
        sections, firsts, marks = self.splitter.sections(texts)
        parts: list[bytes] = []
        for begin, end in groups_by_size(sections):
            text, codes, starts, words = self.splitter.split(sections[begin:end])
            if not len(starts):
                parts += [b""] * (end - begin)
                continue
            entries = self.memory.entries(text, codes, starts)
            raw = self.memory.gather(entries).tobytes()
            sizes = document_sums(self.memory.count[entries], words) * int(self.width[2])
            ends = np.cumsum(sizes)
            parts += [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        for section, mark in marks:
            parts[section] += self.special[mark]
        if len(sections) == len(texts):
            return parts
        return [b"".join(parts[a:b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]


def key_hashes(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(np.asarray(keys, np.int64).view(np.uint64), 1000 + seed)


class ShardIndex:
    """Offsets of a shard's documents, and constant-time lookup by key."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.offsets, self.keys, self.null = parts["offsets"], parts["keys"], parts["null"]
        self.seed = int(parts["seed"][0])
        self.fingerprints, self.first, self.count = parts["fingerprints"], parts["first"], parts["count"]
        cuts = np.cumsum(parts["levels"])[:-1]
        self.hash = MinimalPerfectHash(np.split(parts["words"], cuts) if len(parts["words"]) else [])

    @staticmethod
    def build(keys: list[int | None], sizes: list[int]) -> bytes:
        """The content of an index file for documents with these keys and numbers of ids, in order."""
        null = np.array([k is None for k in keys], bool)
        values = np.array([0 if k is None else k for k in keys], np.int64)
        present = np.flatnonzero(~null)
        distinct, first, count = np.unique(values[present], return_index=True, return_counts=True)
        for seed in itertools.count():
            hashed = key_hashes(distinct, seed)
            try:
                function = MinimalPerfectHash.build(hashed)
                break
            except ValueError:
                continue
        slots = function.slots(hashed)
        fingerprints, firsts, counts = (np.zeros(len(distinct), t) for t in ("<u4", "<i8", "<i8"))
        fingerprints[slots] = (hashed >> np.uint64(32)).astype("<u4")
        firsts[slots], counts[slots] = present[first], count
        out = io.BytesIO()
        words = np.concatenate(function.words) if function.words else np.zeros(0, "<u8")
        np.savez(out, offsets=np.concatenate(([0], np.cumsum(sizes))).astype("<i8"), keys=values, null=null, seed=np.array([seed]), fingerprints=fingerprints, first=firsts, count=counts, words=words, levels=np.array([len(w) for w in function.words], np.int64))
        return out.getvalue()

    @classmethod
    def read(cls, raw: bytes) -> ShardIndex:
        with np.load(io.BytesIO(raw)) as parts:
            return cls({k: parts[k] for k in parts.files})

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; -1 and 0 where the fingerprint says that it is absent."""
        hashed = key_hashes(keys, self.seed)
        slots = self.hash.slots(hashed)
        ok = slots >= 0
        if len(self.fingerprints):
            ok &= self.fingerprints[np.maximum(slots, 0)] == (hashed >> np.uint64(32)).astype("<u4")
            return np.where(ok, self.first[np.maximum(slots, 0)], -1), np.where(ok, self.count[np.maximum(slots, 0)], 0)
        return np.full(len(slots), -1), np.zeros(len(slots), np.int64)


class Shard:
    """Random access to one shard."""

    def __init__(self, ids_path: str, index_path: str):
        self.index = ShardIndex.read(read_bytes(index_path))
        self.stream = open_input(ids_path)
        head = self.stream.read(8)
        if head[:7] != MAGIC:
            raise ValueError("this is no shard")
        self.width = f"<u{head[7]}"
        if self.stream.size() != 8 + int(self.index.offsets[-1]) * head[7]:
            raise ValueError("the shard and its index differ in length")

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids of the records from ``first`` up to but without ``last``."""
        step = int(self.width[2])
        a, b = int(self.index.offsets[first]), int(self.index.offsets[last])
        self.stream.seek(8 + a * step)
        return np.frombuffer(self.stream.read((b - a) * step), self.width)

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every record with a key."""
        first, count = (int(x[0]) for x in self.index.lookup(np.array([key])))
        return [self.read(i, i + 1) for i in range(first, first + count)]


class _ShardWriter:
    """Writes documents to one shard after another; ids go straight to the file."""

    def __init__(self, folder: str, task: int, width: str):
        self.folder, self.task, self.width, self.number = folder, task, width, 0
        self.file: AtomicFile | None = None

    def add(self, key: int | None, ids: bytes) -> None:
        if self.file is None:
            self.stem = f"{self.folder}/shard-{self.task:06d}-{self.number:04d}"
            self.file = AtomicFile(self.stem + ".ids")
            self.file.write(MAGIC + bytes([int(self.width[2])]))
            self.keys: list[int | None] = []
            self.sizes: list[int] = []
        self.keys.append(key)
        self.sizes.append(len(ids) // int(self.width[2]))
        self.file.write(ids)

    def full(self) -> bool:
        return len(self.keys) >= SHARD_DOCUMENTS or self.file.written >= SHARD_BYTES

    def close(self) -> tuple:
        self.file.close()
        index = AtomicFile(self.stem + ".idx")
        index.write(ShardIndex.build(self.keys, self.sizes))
        index.close()
        done = (self.task, self.number, self.stem, len(self.keys), sum(self.sizes))
        self.file, self.number = None, self.number + 1
        return done


#: Quantiles of the keys that are looked at: a key at two of them, or null at that share of the rows, is common.
QUANTILES = 200


def key_order(rows: DataFrame) -> list:
    """What range partitions are cut by: the key, and where a key is common also a hash of the text."""
    ranks = [i / QUANTILES for i in range(QUANTILES + 1)]
    cuts, nulls, total = rows.agg(F.percentile_approx("key", ranks, 4 * QUANTILES), F.count(F.when(F.col("key").isNull(), 1)), F.count("*")).first()
    common = nulls * QUANTILES > total or len(set(cuts or [])) < len(cuts or [])
    return [F.col("key").asc_nulls_first(), *([F.xxhash64("text").asc()] if common else [])]


_LOADED: dict[str, IdEncoder] = {}


def write_shards(documents: DataFrame, path: str, folder: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode all texts and write them in key order.  Gives the stored manifest: task, number, stem, n_records, n_ids, and base, the ids before the shard."""
    spec = documents.sparkSession.sparkContext.broadcast(describe(path))
    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = key_order(rows)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    schema = "task int, number int, stem string, n_records long, n_ids long"
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = IdEncoder(spec.value)
        encoder, done = _LOADED[path], []
        end = np.array([end_id], encoder.width).tobytes()
        writer = _ShardWriter(folder, TaskContext.get().partitionId(), encoder.width)
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                for k, ids in zip(piece.column("key").to_pylist(), encoder.encode(piece.column("text").to_pylist()), strict=True):
                    writer.add(k, ids + end)
                    if writer.full():
                        done.append(writer.close())
        if writer.file is not None:
            done.append(writer.close())
        columns = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["task", "number", "stem", "n_records", "n_ids"])

    manifest = stored(ordered.mapInArrow(write, schema), "shards")
    # One row a shard: the running sum over them is small at any size of the corpus.
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """For every document, found by its key through the index: key, start (ids of all documents before it), n_ids, ids_crc32 (of the ids as 32-bit integers)."""
    tasks = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int64()], ["key", "start", "n_ids", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(stem + ".ids", stem + ".idx")
                index = shard.index
                present = ~index.null
                keys = np.unique(index.keys[present])
                first, count = index.lookup(keys)
                if (count == 0).any() or int(count.sum()) != int(present.sum()):
                    raise ValueError(f"the index of {stem} misses keys")
                records = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                records = np.concatenate((np.flatnonzero(index.null), records))
                owners = [None] * int((~present).sum()) + np.repeat(keys, count).tolist()
                offsets, at = index.offsets, 0
                while at < len(records):
                    low, stop = int(records[at]), at + 1
                    while stop < len(records) and records[stop] == records[stop - 1] + 1 and offsets[records[stop] + 1] - offsets[low] <= READ_IDS:
                        stop += 1
                    ids = shard.read(low, int(records[stop - 1]) + 1).astype("<u4")
                    own = offsets[low : low + stop - at + 1]
                    crc = [zlib.crc32(ids[a - own[0] : b - own[0]]) for a, b in zip(own[:-1], own[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((owners[at:stop], base + own[:-1], np.diff(own), crc), kinds, strict=True)], names=names)
                    at = stop

    return manifest.select("stem", "base").repartition(tasks).mapInArrow(read, "key long, start long, n_ids long, ids_crc32 long")


def write_and_read(documents: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write all documents to shards in shared storage and read every one back through the index."""
    return read_documents(write_shards(documents, path, fresh(documents.sparkSession, "ids"), end_id))
