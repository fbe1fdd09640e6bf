"""Shared storage for intermediate tables and output files.

Everything that one task writes and another reads goes below the folder named
by ``spark.checkpoint.dir``, which the driver and all executors can reach.
A folder of our own is only chosen where that setting is empty and the session
runs in one process (tests); on a cluster an empty setting is an error.
"""

from __future__ import annotations

import atexit
import posixpath
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

UNSET_DIR = "/tmp/checkpoints"


def root(spark: SparkSession) -> str:
    """The shared folder of this session, as a path or URI without final slash."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = UNSET_DIR
    return folder.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody has used before.  What lies there is deleted when the driver's process ends, or by :func:`release`."""
    path = f"{root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def release() -> None:
    """Delete all intermediate tables and files of this process.  Results that still have to read them are lost."""
    while _MADE:
        try:
            files, path = locate(_MADE.pop())
            files.delete_dir(path)
        except (OSError, ValueError):
            continue  # never written, or another's task


atexit.register(release)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: lost executors cost no recomputation of what came before,
    and several readers share one computation.
    """
    path = fresh(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path for a Hadoop-style URI or a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class AtomicFile:
    """Binary output that appears under its name only once it is complete.

    A task that is run again, or twice at a time, writes to a name of its own
    and moves the file over the finished one, whose content is the same.
    """

    def __init__(self, uri: str):
        self.uri = uri
        self.files, self.path = locate(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.files.create_dir(posixpath.dirname(self.path), recursive=True)
        self.stream = self.files.open_output_stream(self.temporary)
        self.written = 0

    def write(self, data) -> None:
        self.stream.write(data)
        self.written += len(data)

    def close(self) -> None:
        self.stream.close()
        self.files.move(self.temporary, self.path)


def read_bytes(uri: str) -> bytes:
    files, path = locate(uri)
    with files.open_input_stream(path) as stream:
        return stream.read()


def open_input(uri: str):
    """Seekable binary input."""
    files, path = locate(uri)
    return files.open_input_file(path)
