"""FNV-1a, SipHash-1-3 and SimHash of token bags."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of FNV-1a with 64 bits.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(c: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes as a signed integer.

    The state is kept as two halves of 32 bits, so that no product overflows.
    """
    data = F.hex(c.cast("binary"))
    size = F.octet_length(c)
    start = F.struct(F.lit(FNV_START >> 32).cast("long").alias("hi"), F.lit(FNV_START & 0xFFFFFFFF).cast("long").alias("lo"))

    def step(s: Column, i: Column) -> Column:
        byte = F.conv(F.substr(data, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
        x = s["lo"].bitwiseXOR(byte)
        low = x * 435
        high = (s["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x, 8)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        return F.struct(high.alias("hi"), low.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("lo"))

    bytes_ = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(bytes_, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def fnv1a_many(words: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full(len(words), FNV_START, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), np.uint8)
    live = order
    for i in range(int(sizes.max()) if len(words) else 0):
        live = live[: int(np.searchsorted(-sizes[live], -i, "left"))]
        out[live] = (out[live] ^ data[starts[live] + i]) * np.uint64(FNV_PRIME)
    return out


#: What is neither a letter, a digit nor white space.
_NEITHER = re.compile(r"[^\w\s]|_")


def simhash_text(text: str, known: dict[str, int]) -> int:
    """Majority of the token hashes for each bit; tokens are split at white space and stripped of all but letters and digits."""
    bag = _NEITHER.sub("", text.lower()).split()
    if not bag:
        return 0
    new = list({t for t in bag if t not in known})
    if new:
        known.update(zip(new, fnv1a_many([t.encode() for t in new]).tolist(), strict=True))
    bits = np.unpackbits(np.array([known[t] for t in bag], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(bag)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def with_simhash(df: DataFrame, text: str = "text", out: str = "simhash") -> DataFrame:
    """Add the SimHash of a text column as a signed integer.  Null texts have 0."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            hashes = np.array([simhash_text(t or "", known) for t in batch.column(names.index(text)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64())], names=[*names, out])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, `{out}` long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def siphash13(data: bytes) -> int:
    """SipHash-1-3 with key 0 over the bytes and a final 0xFF."""
    m64 = (1 << 64) - 1
    rotate = lambda x, b: (x << b | x >> (64 - b)) & m64
    # Fixed values of SipHash.
    v0, v1, v2, v3 = 0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573

    def mix(v0: int, v1: int, v2: int, v3: int) -> tuple[int, int, int, int]:
        v0 = (v0 + v1) & m64
        v1 = rotate(v1, 13) ^ v0
        v0 = rotate(v0, 32)
        v2 = (v2 + v3) & m64
        v3 = rotate(v3, 16) ^ v2
        v0 = (v0 + v3) & m64
        v3 = rotate(v3, 21) ^ v0
        v2 = (v2 + v1) & m64
        v1 = rotate(v1, 17) ^ v2
        v2 = rotate(v2, 32)
        return v0, v1, v2, v3

    data += b"\xff"
    tail = len(data) % 8
    blocks = [*struct.unpack(f"<{len(data) // 8}Q", data[: len(data) - tail]), int.from_bytes(data[len(data) - tail :], "little") | (len(data) & 0xFF) << 56]
    for block in blocks:
        v3 ^= block
        v0, v1, v2, v3 = mix(v0, v1, v2, v3)
        v0 ^= block
    v2 ^= 0xFF
    for _ in range(3):
        v0, v1, v2, v3 = mix(v0, v1, v2, v3)
    return v0 ^ v1 ^ v2 ^ v3


@F.pandas_udf(T.StringType())
def siphash_hex(s: pd.Series) -> pd.Series:
    """SipHash-1-3 of strings as 16 hex digits."""
    return s.map(lambda x: None if x is None else f"{siphash13(x.encode()):016x}")


def document_id(unique_id: Column, url: Column) -> Column:
    """The trimmed unique id, or "u" and the FNV-1a of the URL where there is none."""
    own = F.trim(F.coalesce(unique_id, F.lit("")))
    return F.when(own != "", own).otherwise(F.concat(F.lit("u"), F.lpad(F.lower(F.hex(fnv1a(F.coalesce(url, F.lit(""))))), 16, "0")))
