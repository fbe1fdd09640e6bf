"""Fetching behind an injectable client, crawls over listing pages, dataset downloads and external commands.

A client is a factory: called once a task it gives a function from a URL to
(status, bytes).  :func:`http_client` makes one of the standard library; status
0 means that no answer came.
"""

from __future__ import annotations

import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_of
from .crawl import discover_links, not_retrieved, robots_allowed

Client = Callable[[], Callable[[str], tuple[int, bytes]]]


@dataclass(frozen=True)
class HttpSettings:
    """How to ask: agent, proxy, referrer, further headers, timeout, tries and the wait that doubles between them (at most a minute)."""

    user_agent: str = "gleaner"
    proxy: str | None = None
    referrer: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 30.0
    tries: int = 3
    wait: float = 2.0


def http_client(settings: HttpSettings) -> Client:
    """A client over HTTP that asks again where the status says that this may help."""

    def make():
        proxies = [urllib.request.ProxyHandler({"http": settings.proxy, "https": settings.proxy})] if settings.proxy else []
        opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(), *proxies)
        heads = {"User-Agent": settings.user_agent, "DNT": "1", **({"Referer": settings.referrer} if settings.referrer else {}), **settings.headers}

        def once(url: str) -> tuple[int, bytes]:
            try:
                with opener.open(urllib.request.Request(url, headers=heads), timeout=settings.timeout) as reply:
                    return reply.status, reply.read()
            except urllib.error.HTTPError as error:
                return error.code, b""
            except (OSError, ValueError):
                return 0, b""

        def fetch(url: str) -> tuple[int, bytes]:
            for attempt in range(settings.tries):
                status, body = once(url)
                if not (status == 0 or status >= 500 or status in (408, 429)) or attempt + 1 == settings.tries:
                    break
                time.sleep(min(settings.wait * 2**attempt, 60))
            return status, body

        return fetch

    return make


def fetch(urls: DataFrame, client: Client, host_interval: float = 0.0) -> DataFrame:
    """url, status and body of each distinct URL.

    All URLs of a host are asked for by one task, one after another and
    ``host_interval`` seconds apart: that pace, not the cluster, bounds a host.
    Nothing but the reply at hand is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, last = client(), {}
        for batch in batches:
            for url, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wait = last.get(host, -host_interval) + host_interval - time.monotonic() if host_interval else 0
                if wait > 0 and host in last:
                    time.sleep(wait)
                last = {host: time.monotonic()}
                status, body = get(url)
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([status], pa.int32()), pa.array([body], pa.binary())], names=["url", "status", "body"])

    hosts = urls.where(F.col("url").isNotNull()).select("url").distinct().withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    return hosts.repartition("host").sortWithinPartitions("host", "url").mapInArrow(run, "url string, status int, body binary")


def crawl(listings: DataFrame, history: DataFrame, rules: DataFrame, client: Client, accept: Callable[[Column], Column] | None = None, host_interval: float = 0.0) -> DataFrame:
    """url, status and html of the articles that listing pages (url, html) link to.

    Left out are URLs in the history, those that ``accept`` refuses, and those
    that the sites' rules for robots forbid.
    """
    new = not_retrieved(discover_links(listings), history)
    if accept is not None:
        new = new.where(accept(F.col("url")))
    allowed = robots_allowed(new, rules).where("allowed").select("url")
    return fetch(allowed, client, host_interval).select("url", "status", F.when(F.col("status").between(200, 299), F.col("body").cast("string")).alias("html"))


def dataset_file(module: str, url: Column, day: Column) -> Column:
    """File name of a downloaded spreadsheet: module, at most 48 characters of its stem, and the day (YYYY-MM-DD)."""
    name = F.when(url.contains("/"), F.substring_index(url, "/", -1)).otherwise("data")
    stem = F.substring(F.regexp_replace(name, r"\.[^.]*$", ""), 1, 48)
    return F.concat(F.lit(f"{module}_"), stem, F.lit("_"), F.replace(day, F.lit("-"), F.lit("_")), F.lit(".xlsx"))


def run_command(df: DataFrame, command: list[str], argument: str = "filename", timeout: float = 300.0) -> DataFrame:
    """Run an external command for each row with a column as its last argument, on the executors; adds exit_code and output.

    No shell is involved.  Where the command can't be started or takes too long
    the exit code is null.  A task that is run again runs its commands again.
    """
    names = df.columns
    at = names.index(argument)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, outputs = [], []
            for value in batch.column(at).to_pylist():
                try:
                    done = subprocess.run([*command, value or ""], capture_output=True, timeout=timeout)
                    codes.append(done.returncode)
                    outputs.append(done.stdout.decode("utf-8", "replace"))
                except (OSError, ValueError, subprocess.TimeoutExpired):
                    codes.append(None)
                    outputs.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32()), pa.array(outputs, pa.string())], names=[*names, "exit_code", "output"])

    return df.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + ["exit_code int", "output string"]))
