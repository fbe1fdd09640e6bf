"""WARC archives compressed with Zstandard and a shared dictionary.

An archive is a file whose first frame is a skippable one with the dictionary;
every record after it is one Zstandard frame made with that dictionary.  The
writer groups pages by the SHA-1 of their payload: the record with the largest
page_id keeps the payload (response), the others refer to it (revisit).

Cases: a null html is an empty payload; a null page_id ranks below all others,
and rows that repeat the largest page_id of a payload are all responses (nothing
tells them apart); a null url leaves out the target header; control characters
and spaces in a url are percent-encoded; an empty table gives no archive and an
empty result.  Groups of any size are handled: the largest page_id comes from a
pre-aggregated maximum, and payloads that many pages share get it by a broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import join_unique
from .workspace import AtomicFile, fresh, open_input, stored

#: The skippable frame that holds a dictionary, and ordinary frames.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC, DICTIONARY_MAGIC = b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
MAX_BATCH_BYTES, MAX_BATCH_ROWS = 16 << 20, 4000


class WarcError(ValueError):
    """A record or frame that breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary from sample payloads; plain boilerplate where there are too few to train from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return record("response", 0, "http://a.example/", "<!DOCTYPE html><html><head><title></title></head><body><p></p></body></html>".encode(), "A" * 32)


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary in it is compressed itself."""
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One uncompressed record of a page; a revisit's block has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record.  Raises WarcError if a header is missing or a length or digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not re.match(rb"WARC/1\.[01]\r\n", head):
        raise WarcError("no WARC header")
    headers: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the length is wrong")
    block = rest[:-4]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise WarcError("the block's digest is wrong")
    return headers, block


def read_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading frame: one Zstandard frame, whole, or a dictionary as it is.  Raises WarcError for anything else."""
    if content[:4] == FRAME_MAGIC:
        unpacker = zstandard.ZstdDecompressor().decompressobj()
        try:
            plain = unpacker.decompress(content)
        except zstandard.ZstdError as error:
            raise WarcError(f"the dictionary cannot be read: {error}") from error
        if not unpacker.eof or unpacker.unused_data:
            raise WarcError("the dictionary's frame ends early or late")
        return zstandard.ZstdCompressionDict(plain)
    if content[:4] != DICTIONARY_MAGIC:
        raise WarcError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content)


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one per frame; ``stream`` is a binary file.

    Raises WarcError for bytes that are no frame, a frame that ends early, and
    a dictionary frame that cannot be read.
    """
    buffer, dictionary, first = b"", None, True
    while True:
        while len(buffer) < 8:
            more = stream.read(READ_BYTES)
            if not more:
                break
            buffer += more
        if not buffer:
            return
        if len(buffer) < 5:
            raise WarcError("a frame ends early")
        magic = int.from_bytes(buffer[:4], "little")
        if magic in SKIPPABLE:
            if len(buffer) < 8:
                raise WarcError("a frame ends early")
            size = int.from_bytes(buffer[4:8], "little")
            pieces, have = [buffer[8:]], len(buffer) - 8
            while have < size:
                more = stream.read(READ_BYTES)
                if not more:
                    raise WarcError("a frame ends early")
                pieces.append(more)
                have += len(more)
            joined = b"".join(pieces)
            content, buffer = joined[:size], joined[size:]
            if magic == DICTIONARY_FRAME and first:
                dictionary = read_dictionary(content)
            first = False
            continue
        first = False
        if buffer[:4] != FRAME_MAGIC:
            raise WarcError("no Zstandard frame")
        parts = []
        try:
            unpacker = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            while True:
                parts.append(unpacker.decompress(buffer))
                if unpacker.eof:
                    buffer = unpacker.unused_data
                    break
                buffer = stream.read(READ_BYTES)
                if not buffer:
                    raise WarcError("a frame ends early")
        except zstandard.ZstdError as error:
            raise WarcError(str(error)) from error
        yield b"".join(parts)


class ArchiveWriter:
    """Archives of about :data:`ARCHIVE_BYTES` each below a folder, named after a task."""

    def __init__(self, folder: str, task: int, dictionary: bytes):
        self.folder, self.task, self.lead = folder, task, dictionary_frame(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.file: AtomicFile | None = None
        self.number = self.records = 0

    def add(self, raw: bytes) -> None:
        if self.file is None:
            self.uri = f"{self.folder}/part-{self.task:06d}-{self.number:04d}.warc.zst"
            self.file = AtomicFile(self.uri)
            self.file.write(self.lead)
            info = b"software: gleaner\r\nformat: WARC File Format 1.1\r\n"
            self.file.write(self.compressor.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:%d:%d>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (self.task, self.number, len(info), info)))
            self.records = 0
        self.file.write(self.compressor.compress(raw))
        self.records += 1

    def full(self) -> bool:
        return self.file is not None and self.file.written >= ARCHIVE_BYTES

    def close(self) -> tuple[str, int, int]:
        """Path, records and bytes of the archive that is closed."""
        self.file.close()
        done = (self.uri, self.records, self.file.written)
        self.file, self.number = None, self.number + 1
        return done


def write_archives(pages: DataFrame, folder: str, samples: int = 500) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record.  Gives the stored manifest: path, n_records, n_bytes.

    The dictionary is trained on the first 16 KB of at most ``samples`` pages;
    it has no influence on what is read back.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    chosen = stored(rows.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")), "warc-responses")
    dictionary = train_dictionary([r[0].encode()[: 16 << 10] for r in rows.select(F.substring("html", 1, 16 << 10)).limit(samples).collect()])
    shared = spark.sparkContext.broadcast(dictionary)
    marked = join_unique(rows, chosen, "digest", "copies").select("page_id", "url", "html", "response_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = ArchiveWriter(folder, TaskContext.get().partitionId(), shared.value), []
        for batch in batches:
            for page, url, html, response in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, response, payload = page.as_py(), response.as_py(), html.as_py().encode()
                kind = "response" if page == response else "revisit"
                writer.add(record(kind, page, url.as_py(), payload, base32_sha1(payload), response))
                if writer.full():
                    done.append(writer.close())
        if writer.file is not None:
            done.append(writer.close())
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "n_records", "n_bytes"])

    return stored(marked.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def _page(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Page records of the archives in a manifest: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits).

    Each frame is decoded on its own; headers, lengths and digests are verified.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=names)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = 0
                with open_input(path) as stream:
                    for raw in frames(stream):
                        headers, block = parse_record(raw)
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        found += 1
                        http, gap, body = block.partition(b"\r\n\r\n")
                        length = re.search(rb"\r\nContent-Length: (\d+)", http)
                        if not gap or not length:
                            raise WarcError("no HTTP header")
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        whole = headers["warc-type"] == "response"
                        if whole and (len(body) != int(length[1]) or base32_sha1(body) != digest):
                            raise WarcError("the payload's length or digest is wrong")
                        rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], _page(headers.get("warc-refers-to")), int(length[1]), digest, body if whole else None))
                        held += len(body)
                        if held >= MAX_BATCH_BYTES or len(rows) >= MAX_BATCH_ROWS:
                            yield flush()
                            rows.clear()
                            held = 0
                if found != expected:
                    raise WarcError(f"{path} has {found} records, not {expected}")
        yield flush()

    return manifest.select("path", "n_records").repartition(tasks).mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in shared storage and give their records as read back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, fresh(spark, "warc")))
