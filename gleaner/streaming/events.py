"""Streams over event files: windows with watermarks, and first-wins by key in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: State is held by RocksDB, on the executors' disks beyond a bounded buffer, and not in their heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
UNSET_DIR = "/tmp/checkpoints"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The rows of tables named so, each a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{glob}").schema
    # A stream takes a single file only by a pattern, and a name filter would leave out a folder's part files.
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{glob}}}").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and values by window and type, with a watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once, as long as it comes again within the watermark's delay; state of older keys is forgotten."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _shared(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the driver and all executors reach, with an empty table in it; deleted when the driver's process ends."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = UNSET_DIR
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{label}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path.suffix("/table"))
    files.deleteOnExit(path)
    return path.toString()


def run_available(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and give its result table, which tasks write into the shared folder; the driver holds no rows."""
    if mode not in ("append", "complete"):
        raise ValueError(f"no result table in mode {mode}")
    spark = df.sparkSession
    folder = _shared(spark, name)
    table = f"{folder}/table"
    writer = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("compression", "zstd").option("path", table)
    else:  # each batch has the whole result; Spark's file sink only appends
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").option("compression", "zstd").parquet(table))
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = writer.start()  # keeps the session's settings as they are now
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(table)
