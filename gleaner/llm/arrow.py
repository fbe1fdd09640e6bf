"""Helpers for operators that work on Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that one step of a vectorised operator holds at a time.
SLICE_BYTES = 2 << 20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row begins (one more for the end).  Null rows are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows with about ``limit`` bytes of text each; a longer row is a piece of its own."""
    _, starts = text_buffer(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(starts, starts[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def per_text(df: DataFrame, keys: list[str], text: str, schema: str, make: Callable[[], Callable[[list[str]], list[tuple]]]) -> DataFrame:
    """Add columns that are computed from one text column.

    ``schema`` names the new columns; ``make()`` is called once a task and gives
    a function from texts to rows of those columns.  Null texts arrive as "".
    Of the input only ``keys`` and the text are read.
    """
    kept = df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("__text"))
    head = ", ".join(f"`{k}` {t}" for k, t in kept.dtypes[:-1])
    out = f"{head}, {schema}" if head else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in slices(batch, "__text"):
                texts = ["" if x is None else x for x in piece.column("__text").to_pylist()]
                rows = work(texts)
                columns = [list(c) for c in zip(*rows, strict=True)]
                arrays = [piece.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    arrow = to_arrow_schema(T.StructType.fromDDL(out))
    names, kinds = arrow.names, [f.type for f in arrow][len(keys) :]
    return kept.mapInArrow(run, out)
