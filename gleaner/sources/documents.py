"""Document sources and file sinks."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = """module string, plugin_name string, section_name string, url string, pdf_url string, filename string, html_content string, title string, unique_id string,
referrer_text string, text string, source_author string, recipients string, source_name array<string>, keywords array<string>, industries array<string>,
revision_dates array<string>, links_inward array<string>, links_outwards array<string>, publish_date_ms bigint, publish_date string,
text_parts array<struct<id:string,text:string,summary:string,insights:string>>, classification map<string,string>, generated_content map<string,string>, data_proc_flags int"""

#: Output names of renamed fields; the page and the referrer are not written.
RENAMED = {"source_name": "sourceName", "publish_date": "pubdate", "url": "URL", "unique_id": "uniqueID"}
DROPPED = ("html_content", "referrer_text")


def read_json(spark: SparkSession, path: str, least_bytes: int = 1) -> DataFrame:
    """Documents from a folder of JSON files, one each; either spelling of the renamed fields is read."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).where(F.col("_metadata.file_size") >= least_bytes)
    raw = files.select("value", F.from_json("value", DOCUMENT).alias("d"), F.col("_metadata.file_path").alias("path"))
    columns = []
    for field in T.StructType.fromDDL(DOCUMENT):
        value = F.col(f"d.{field.name}")
        if field.name in RENAMED:
            other = F.get_json_object("value", f"$.{RENAMED[field.name]}")
            value = F.coalesce(value, other if field.dataType == T.StringType() else F.from_json(other, field.dataType.simpleString()))
        columns.append((F.col("path") if field.name == "filename" else value).alias(field.name))
    return raw.select(*columns)


def output_columns(df: DataFrame) -> DataFrame:
    """Documents under their output names."""
    return df.select(*[F.col(c).alias(RENAMED.get(c, c)) for c in df.columns if c not in DROPPED])


def write_dated_json(df: DataFrame, path: str) -> None:
    """Output JSON below year and day."""
    df.withColumn("year", F.substring("publish_date", 1, 4)).withColumn("day", F.col("publish_date")).transform(output_columns).write.partitionBy("year", "day").mode("append").json(path, compression="gzip")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Documents (url, title, text, publish_date) of all JSON entries in all ZIP files below a folder; those without URL or text are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in sorted(z.namelist()):
                        if entry.endswith(".json"):
                            d = json.loads(z.read(entry))
                            url, text = d.get("URL") or d.get("url"), d.get("text")
                            if url and text:
                                rows.append((name, entry, url, d.get("title"), text, d.get("pubdate") or d.get("publish_date")))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 6, names=["archive", "entry", "url", "title", "text", "publish_date"])

    return files.mapInArrow(run, "archive string, entry string, url string, title string, text string, publish_date string")


def is_pdf(content: Column) -> Column:
    """Whether bytes begin as a PDF file does."""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def read_pdfs(spark: SparkSession, path: str, reader: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """Documents (filename, module, title, text) of the PDF files below a folder; other content under that ending is left out.

    ``reader`` is called once a task and gives a function from a file's bytes to
    its text, for instance a PDF library's or a character recogniser's.  A file
    that it fails on has an empty text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    names = F.regexp_extract("path", r"([^/]*)\.pdf$", 1)
    chosen = files.where(is_pdf(F.col("content"))).select(F.col("path").alias("filename"), F.lit("PDF").alias("module"), names.alias("title"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            texts = []
            for content in batch.column(3).to_pylist():
                try:
                    texts.append(read(content))
                except Exception:  # one damaged file doesn't end the scan
                    texts.append("")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["filename", "module", "title", "text"])

    return chosen.mapInArrow(run, "filename string, module string, title string, text string")
