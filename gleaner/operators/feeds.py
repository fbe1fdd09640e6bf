"""Periodic feeds: which are due, running them side by side, and the ledger afterwards."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import record_results, should_skip

LEDGER = "source string, dataset string, last_attempt_ts long, last_success_ts long, status string, rows_ingested long, message string"


@dataclass(frozen=True)
class Outcome:
    ok: bool
    rows: int = 0
    message: str = ""


@dataclass(frozen=True)
class Feed:
    """A job; ``run`` gives its outcome and may raise."""

    source: str
    dataset: str
    run: Callable[[SparkSession], Outcome]
    frequency_days: int = 1


def run_feeds(spark: SparkSession, feeds: list[Feed], ledger: DataFrame, now: int) -> DataFrame:
    """Run the feeds that are due, each in a thread of the driver, and give the ledger after it.  A feed that raises has failed."""
    if not feeds:
        return ledger
    table = spark.createDataFrame([(f.source, f.dataset, f.frequency_days) for f in feeds], "source string, dataset string, frequency_days int")
    due = {(r["source"], r["dataset"]) for r in should_skip(table, ledger, F.lit(now)).where("not skip").collect()}

    def attempt(feed: Feed) -> tuple:
        try:
            done = feed.run(spark)
        except Exception as error:
            done = Outcome(False, 0, str(error))
        return feed.source, feed.dataset, now, done.ok, done.rows, done.message

    wanted = [f for f in feeds if (f.source, f.dataset) in due]
    with ThreadPoolExecutor(max_workers=8) as pool:
        results = list(pool.map(attempt, wanted))
    return record_results(ledger, spark.createDataFrame(results, "source string, dataset string, ts long, ok boolean, rows long, message string"))
