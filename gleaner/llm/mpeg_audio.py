"""Media columns: MPEG audio streams.

:func:`scan` reads a stream: it skips and parses ID3 tags, finds frames by
their headers (a header counts if the next frame's header follows it, a tag, or
the end), resynchronises after damage, parses the Xing/Info or VBRI table, verifies
the CRC of protected frames of all layers, and gives the exact duration and the
offset of every frame.  Frames of free format are as long as it is to the next
header of their kind.  An ID3v1 tag is one only where no frame covers it.  :func:`pack` writes a payload losslessly as a variable-bitrate
Layer III stream: granules without main data (silence) whose ancillary bytes
carry the payload; :func:`unpack` reads it back.

Cases: a null or empty text has a payload of 64 zero bytes; equal texts give
equal streams; a stream without any frame has duration 0; bytes that are no
frames are counted as ``skipped``; texts are stored whole at any length.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import per_text
from .workspace import stored

# Fixed values of the MPEG audio format: kbit/s by (version 1?, layer) and index, Hz by version bits and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Fixed values of Layer II: bits of allocation of each subband, by the table that a rate and bitrate select.
ALLOCATION = {
    "a": [4] * 11 + [3] * 12 + [2] * 4,
    "b": [4] * 11 + [3] * 12 + [2] * 7,
    "c": [4] * 2 + [3] * 6,
    "d": [4] * 2 + [3] * 10,
    "lsf": [4] * 4 + [3] * 7 + [2] * 19,
}

UNIT = 64
PACK_RATE = 48000
SIDE_BYTES = 17
HEAD_BYTES = 4 + 2 + SIDE_BYTES


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    size: int  # 0: free format
    samples: int
    bound: int  # subbands with an allocation for each channel (layers I and II)

    @property
    def kind(self) -> tuple[int, int, int, bool]:
        """What all frames of a stream share."""
        return self.version, self.layer, self.rate, self.size == 0

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@functools.lru_cache(maxsize=4096)
def parse_header(head: bytes) -> Header | None:
    """A frame header of 4 bytes, or None if it is none.  The size of a free-format frame, which only its successor tells, is 0."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    kbits, rate = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or kbits == 15 or rate == 3 or head[3] & 3 == 2:
        return None
    bitrate, hertz, padding = BITRATES[version == 3, layer][kbits] * 1000, SAMPLE_RATES[version][rate], head[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = 0 if not bitrate else (12 * bitrate // hertz + padding) * 4 if layer == 1 else samples // 8 * bitrate // hertz + padding
    bound = 4 * (head[3] >> 4 & 3) + 4 if head[3] >> 6 == 1 else 32
    return Header(version, layer, not head[1] & 1, bitrate, hertz, padding, head[3] >> 6 == 3, size, samples, bound)


@functools.lru_cache(maxsize=4096)
def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    return crc16_bits(data, 8 * len(data), crc)


def crc16_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """The same over the first ``bits`` bits."""
    for k in range(bits):
        top = crc >> 15 ^ data[k >> 3] >> 7 - (k & 7) & 1
        crc = (crc << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return crc


def _layer2_widths(head: Header) -> list[int]:
    """Bits of allocation of each subband of a Layer II frame."""
    if head.version != 3:
        return ALLOCATION["lsf"]
    each = head.bitrate // (1 if head.mono else 2)
    if head.bitrate and each <= 48000:
        return ALLOCATION["d" if head.rate == 32000 else "c"]
    return ALLOCATION["a" if head.rate == 48000 or 0 < each <= 80000 else "b"]


def covered_bits(frame: bytes, head: Header) -> int:
    """Bits after the checksum that it covers: side information, or allocations and (Layer II) the selection of scale factors."""
    channels = 1 if head.mono else 2
    if head.layer == 3:
        return 8 * head.side
    if head.layer == 1:
        bound = 32 if head.mono else head.bound
        return 4 * (bound * channels + 32 - bound)
    bits = int.from_bytes(frame[6:38], "big")
    at = chosen = 0
    for band, width in enumerate(_layer2_widths(head)):
        for _ in range(channels if band < head.bound else 1):
            at += width
            if bits >> 256 - at & (1 << width) - 1:
                chosen += channels if band >= head.bound else 1
    return at + 2 * chosen


def checksum_holds(frame: bytes, head: Header) -> bool:
    """Whether the checksum of a protected frame is that of the bits it covers."""
    bits = covered_bits(frame, head)
    if head.layer == 3 and 6 + head.side <= len(frame):
        crc = crc16(frame[2:4] + frame[6 : 6 + head.side])
    elif 48 + bits <= 8 * len(frame):
        crc = crc16_bits(frame[2:4] + frame[6:], 16 + bits)
    else:
        return False
    return crc == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    side: list[int] = field(default_factory=list)
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    resyncs: int = 0

    @property
    def duration(self) -> Fraction:
        """Seconds, exact; encoder delay and padding are taken off where a table states them."""
        total = self.samples - self.table.get("delay", 0) - self.table.get("padding", 0)
        return Fraction(max(total, 0), self.rate) if self.rate else Fraction(0)


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(raw: bytes) -> str:
    """An ID3 text field: encoding byte, then text."""
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(codec, "replace")


def read_id3v2(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag at a position, and where the tag ends (``at`` if there is none)."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return {}, at
    major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
    end = min(at + 10 + size + (10 if flags & 0x10 else 0), len(data))
    body, tags, p = data[at + 10 : at + 10 + size], {}, 0
    if flags & 0x40 and len(body) >= 4:
        p = _synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    wide = 4 if major >= 3 else 3
    while p + 2 * wide + (2 if major >= 3 else 0) <= len(body) and body[p]:
        name, raw = body[p : p + wide].decode("latin-1"), body[p + wide : p + 2 * wide]
        n = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        p += 2 * wide + (2 if major >= 3 else 0)
        if name in ("TXXX", "TXX"):
            key, _, value = _text(body[p : p + n]).partition("\0")
            tags[f"TXXX:{key}"] = value.strip("\0")
        elif name[0] == "T":
            tags[name] = _text(body[p : p + n]).strip("\0")
        p += n
    return tags, end


def read_id3v1(data: bytes) -> dict[str, str]:
    """The tag in the last 128 bytes, if there is one."""
    tail = data[-128:]
    if len(tail) < 128 or tail[:3] != b"TAG":
        return {}
    cut = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}
    return {f"v1:{k}": tail[a:b].split(b"\0")[0].decode("latin-1").strip() for k, (a, b) in cut.items()}


def read_table(frame: bytes, head: Header) -> dict:
    """The Xing, Info or VBRI table of a frame, or {}."""
    for at in (4 + head.side, 6 + head.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            out: dict = {"kind": frame[at : at + 4].decode()}
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
                p += 100
            p += 4 if flags & 8 else 0
            if frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= p + 24:
                gap = int.from_bytes(frame[p + 21 : p + 24], "big")
                out |= {"encoder": frame[p : p + 9].decode("latin-1").strip("\0 "), "delay": gap >> 12, "padding": gap & 0xFFF}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, delay, _, total, frames, entries, scale, width, step = struct.unpack(">HHHIIHHHH", frame[40:62])
        raw = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), width)] if width else []
        return {"kind": "VBRI", "bytes": total, "frames": frames, "toc": toc, "frames_per_entry": step, "delay": delay}
    return {}


#: Bytes within which the frame after one of free format begins; above the longest frame of a stated bitrate.
FREE_REACH = 8192


def _free_size(data: bytes, pos: int, head: Header) -> int:
    """Length without padding of a free-format frame: it ends where the next header of its kind stands; 0 if none does."""
    at = pos + 4
    while 0 <= (at := data.find(data[pos : pos + 2], at, pos + FREE_REACH)):
        follow = parse_header(data[at : at + 4])
        if follow is not None and follow.kind == head.kind:
            return at - pos - head.padding * (4 if head.layer == 1 else 1)
        at += 1
    return 0


def scan(data: bytes) -> Stream:
    """Parse a whole stream.  Offsets are of the audio frames, without the table's own frame."""
    out = Stream()
    end, pos = len(data), 0
    v1 = read_id3v1(data)
    tail = end - 128 if v1 else -1
    anchor: Header | None = None
    lost = False
    free = 0
    upcoming = {b"\xff": -1, b"ID3": -1}  # where each mark stands next, as far as searched

    def fit(pos: int) -> tuple[Header, int] | None:
        """The frame at a position: its header and where it ends."""
        nonlocal free
        head = parse_header(data[pos : pos + 4])
        if head is None or anchor is not None and head.kind != anchor.kind:
            return None
        size = head.size
        if not size:
            base = free or _free_size(data, pos, head)
            if not base:
                return None
            size = base + head.padding * (4 if head.layer == 1 else 1)
        after = pos + size
        if after > end:
            return None
        # A frame directly after a good one is trusted; else what follows must be a frame, a tag or the end.
        if anchor is None or lost:
            follow = parse_header(data[after : after + 4])
            if not (after >= end or after == tail or data[after : after + 3] == b"ID3" or follow is not None and follow.kind == head.kind):
                return None
        if not head.size:
            free = base
        return head, after

    while pos < end:
        if pos == tail:
            out.tags |= v1
            break
        if data[pos] == 0x49:
            tags, after = read_id3v2(data, pos)
            if after > pos:
                out.tags |= tags
                pos, lost = after, False
                continue
        found = fit(pos)
        if found is None:
            for mark, place in upcoming.items():
                if place <= pos:
                    place = data.find(mark, pos + 1, end)
                    upcoming[mark] = place if place >= 0 else end
            step = min(*upcoming.values(), tail if tail > pos else end)
            out.skipped += step - pos
            out.resyncs += not lost
            pos, lost = step, True
            continue
        head, after = found
        frame = data[pos:after]
        if anchor is None:
            out.rate = head.rate
            table = read_table(frame, head)
            anchor = head
            if table:
                out.table, pos, lost = table, after, False
                continue
        if head.protected:
            out.checked += 1
            out.bad_checksums += not checksum_holds(frame, head)
        out.offsets.append(pos)
        out.sizes.append(after - pos)
        out.side.append((6 if head.protected else 4) + head.side)
        out.samples += head.samples
        pos, lost = after, False
    return out


def seek(offsets: list[int], stream_rate: int, samples_per_frame: int, seconds: float) -> int | None:
    """Byte offset of the frame that plays at a time, or None beyond the end."""
    k = int(seconds * stream_rate) // samples_per_frame
    return offsets[k] if 0 <= k < len(offsets) else None


def _header(kbits_index: int, protected: bool) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, kbits_index << 4 | 1 << 2, 0xC0])


@functools.lru_cache(maxsize=16)
def _lead(kbits_index: int) -> np.ndarray:
    """Header, CRC and empty side information of a payload frame."""
    head, side = _header(kbits_index, True), bytes(SIDE_BYTES)
    return np.frombuffer(head + crc16(head[2:] + side).to_bytes(2, "big") + side, np.uint8)


#: Bytes of payload that a frame of each bitrate index holds.
ROOM = [0] + [144 * k * 1000 // PACK_RATE - HEAD_BYTES for k in BITRATES[True, 3][1:]]


def padded(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def pack(raw: bytes) -> bytes:
    """A Layer III stream that carries ``padded(raw)``."""
    payload = padded(raw)
    full, rest = divmod(len(payload), ROOM[14])
    frames = np.empty((full, HEAD_BYTES + ROOM[14]), np.uint8)
    frames[:, :HEAD_BYTES] = _lead(14)
    frames[:, HEAD_BYTES:] = np.frombuffer(payload, np.uint8, full * ROOM[14]).reshape(full, ROOM[14])
    body = frames.tobytes()
    sizes = [frames.shape[1]] * full
    if rest:
        k = next(i for i in range(1, 15) if ROOM[i] >= rest)
        body += _lead(k).tobytes() + payload[full * ROOM[14] :].ljust(ROOM[k], b"\0")
        sizes.append(HEAD_BYTES + ROOM[k])
    first = 192
    total, n = first + len(body), len(sizes)
    toc = bytes(min(255, (first + sum(sizes[: 1]) * (i * n // 100)) * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    opening = (_header(5, False) + bytes(SIDE_BYTES) + table).ljust(first, b"\0")
    fields = b""
    for key, value in (("payload_bytes", len(payload)), ("text_bytes", len(raw))):
        text = b"\0" + f"{key}\0{value}".encode("latin-1")
        fields += b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(fields)
    tag = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127])
    return tag + fields + opening + body


def unpack(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stream that :func:`pack` made.  Raises ValueError if frames or bytes are missing or checksums fail."""
    stream = stream or scan(data)
    payload = b"".join(data[o + s : o + z] for o, s, z in zip(stream.offsets, stream.side, stream.sizes, strict=True))
    n = int(stream.tags.get("TXXX:payload_bytes", -1))
    if not 0 <= n <= len(payload) or stream.bad_checksums or stream.skipped or len(stream.offsets) != stream.table.get("frames"):
        raise ValueError("the stream is damaged")
    return payload[:n]


def media_table(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys with a binary column ``media``: each text as a stream, written to shared storage and read back."""
    packed = per_text(df, list(keys), text, "media binary", lambda: lambda texts: [(pack(x.encode()),) for x in texts])
    return stored(packed, "media")


def media_features(media: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys with what :func:`scan` finds in a ``media`` column.

    Columns: media_bytes, n_frames, sample_rate, n_samples, duration (exact, as
    "numerator/denominator" seconds), bad_checksums, skipped, resyncs, vbr
    (kind of table or null), tags, seek_offsets.
    """
    kept = media.select(*keys, "media")
    head = ", ".join(f"`{k}` {t}" for k, t in kept.dtypes[:-1])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
    names = ["media_bytes", "n_frames", "sample_rate", "n_samples", "duration", "bad_checksums", "skipped", "resyncs", "vbr", "tags", "seek_offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("media"):
                data = raw.as_py() or b""
                s = scan(data)
                d = s.duration
                rows.append((len(data), len(s.offsets), s.rate, s.samples, f"{d.numerator}/{d.denominator}", s.bad_checksums, s.skipped, s.resyncs, s.table.get("kind"), list(s.tags.items()), s.offsets))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*keys, *names])

    return kept.mapInArrow(run, f"{head}, media_bytes long, n_frames long, sample_rate long, n_samples long, duration string, bad_checksums long, skipped long, resyncs long, vbr string, tags map<string,string>, seek_offsets array<long>")


def digests(media: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digest columns of stored streams, for comparison: the payload's are of bytes read back from the stream."""
    kept = media.select(*keys, "media")
    head = ", ".join(f"`{k}` {t}" for k, t in kept.dtypes[:-1])
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("media"):
                data = raw.as_py()
                s = scan(data)
                payload = unpack(data, s)
                offsets = hashlib.sha256(np.asarray(s.offsets, "<i8").tobytes()).hexdigest()[:16]
                d = s.duration
                feature = f"{s.table['kind']} {len(s.offsets)} frames, {s.rate} Hz, {d.numerator}/{d.denominator} s, crc {s.checked - s.bad_checksums}/{s.checked}, seek {offsets}"
                rows.append((int(s.tags["TXXX:text_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*keys, *names])

    return kept.mapInArrow(run, f"{head}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
