"""Dated ZIP archives: one file a day, entries written once, merging of archives."""

from __future__ import annotations

import io
import os
import shutil
import uuid
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import siphash_hex
from ..functions.text import file_safe
from .documents import output_columns


class _Replacing:
    """A ZIP archive that is extended in a copy of its own, which takes the place of the old file only when it is closed."""

    def __init__(self, path: str):
        self.path, self.copy = path, f"{path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        if os.path.exists(path):
            shutil.copyfile(path, self.copy)
        self.zip = zipfile.ZipFile(self.copy, "a", zipfile.ZIP_DEFLATED)
        self.have = set(self.zip.namelist())

    def add(self, name: str, body: str | bytes) -> bool:
        """Write an entry unless its name is there."""
        if name in self.have:
            return False
        self.zip.writestr(name, body)
        self.have.add(name)
        return True

    def close(self) -> None:
        self.zip.close()
        os.replace(self.copy, self.path)


def last_characters(url: Column, n: int = 64) -> Column:
    """The end of what follows the last slash of a URL (or the last backslash), safe in a file name; empty without either."""
    resource = F.when(url.contains("/"), F.regexp_extract(url, r"([^/]*)$", 1)).when(url.contains("\\"), F.regexp_extract(url, r"([^\\]*)$", 1)).otherwise("")
    return F.right(file_safe(resource), F.lit(n))


def unique_filename(module: Column, url: Column, day: Column, extension: str) -> Column:
    """A file name of module, the end of the URL, the hash of the URL as a number, and date."""
    number = F.conv(siphash_hex(url), 16, 10)
    return F.concat(file_safe(F.concat(module, F.lit("_"))), last_characters(url), F.lit("_"), number, F.lit("_"), day, F.lit("." + extension))


@F.pandas_udf(T.StringType())
def first_csv_member(archive: pd.Series) -> pd.Series:
    """The text of the first member named .csv of each ZIP file; null if it has none or is no ZIP file."""

    def read(raw: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                names = [n for n in z.namelist() if n.lower().endswith(".csv")]
                return z.read(names[0]).decode("utf-8", "replace") if names else None
        except zipfile.BadZipFile:
            return None

    return archive.map(read)


def entries(df: DataFrame) -> DataFrame:
    """publish_date, entry name (module and hash of the URL) and JSON of each document; of several with a name the first by URL and text."""
    named = df.withColumn("__entry", F.concat("module", F.lit("_"), siphash_hex(F.col("url")), F.lit(".json")))
    body = F.to_json(F.struct(*[F.col(c) for c in output_columns(df).columns]))
    out = output_columns(named.withColumnRenamed("__entry", "entry")).withColumn("body", body)
    return out.groupBy(F.col("pubdate").alias("publish_date"), "entry").agg(F.min("body").alias("body"))


def write_dated_zips(df: DataFrame, folder: str) -> DataFrame:
    """Add documents to {year}/{day}.zip; entries that exist are kept.  Gives publish_date and the number of new entries.

    One task writes each day's file, entry by entry; ``folder`` must be a file
    system that executors share.  A file appears or changes only as a whole: a
    task that is lost leaves the old one, and one that runs again begins with it.
    """

    def write(batches):
        done: dict[str, int] = {}
        current, archive = None, None
        for batch in batches:
            for day, entry, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if day != current:
                    if archive:
                        archive.close()
                    archive, current = _Replacing(os.path.join(folder, day[:4], f"{day}.zip")), day
                if archive.add(entry, body):
                    done[day] = done.get(day, 0) + 1
        if archive:
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.string()), pa.array(list(done.values()), pa.int64())], names=["publish_date", "n"])

    rows = entries(df).repartition("publish_date").sortWithinPartitions("publish_date", "entry")
    return rows.mapInArrow(write, "publish_date string, n long")


def merge_zips(source: str, target: str) -> int:
    """Move entries of one archive into another unless their name exists there; the source is deleted.  Gives how many were moved."""
    new = _Replacing(target)
    with zipfile.ZipFile(source) as old:
        moved = sum(new.add(name, old.read(name)) for name in old.namelist())
    new.close()
    os.remove(source)
    return moved
