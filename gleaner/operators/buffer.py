"""Writing in small batches, each whole or not at all."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)
#: Takes rows as dicts, writes them in one transaction, and gives how many it wrote.
Flush = Callable[[list[dict]], int]


class BatchWriter:
    """Rows that wait until there are ``size`` of them, the oldest is ``seconds`` old, or the writer closes.

    A batch whose flush fails is logged and dropped; what follows goes on.
    """

    def __init__(self, flush: Flush, size: int = 50, seconds: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self._flush, self.size, self.seconds, self.clock = flush, size, seconds, clock
        self.pending: list[dict] = []
        self.since = 0.0
        self.written = self.dropped = self.flushes = 0

    def push(self, row: dict) -> None:
        if not self.pending:
            self.since = self.clock()
        self.pending.append(row)
        if len(self.pending) >= self.size or self.clock() - self.since >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        rows, self.pending = self.pending, []
        self.flushes += 1
        try:
            self.written += self._flush(rows)
        except Exception:
            log.exception("a batch of %d rows is dropped", len(rows))
            self.dropped += len(rows)


def write_buffered(df: DataFrame, connect: Callable[[], Flush], size: int = 50, seconds: float = 5.0) -> DataFrame:
    """Write all rows by a flush function that ``connect`` makes in each task.  Gives written, dropped and flushes, a row a task.

    A task that runs again writes its rows again, so a flush should ignore rows that are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BatchWriter(connect(), size, seconds)
        for batch in batches:
            for row in batch.to_pylist():
                writer.push(row)
        writer.flush()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (writer.written, writer.dropped, writer.flushes)], names=["written", "dropped", "flushes"])

    return df.mapInArrow(run, "written long, dropped long, flushes long")
