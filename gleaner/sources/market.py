"""Daily price files: typed and generic CSV, the older layout, sniffing."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dictionaries import LEGACY_PRICE_COLUMNS, MONTHS, PRICE_COLUMNS, PRICE_FILE_CHANGE, PRICE_FILE_NEW, PRICE_FILE_OLD


def looks_like_csv(content: Column) -> Column:
    """Not empty, not markup, and a header with commas at its beginning."""
    text = F.substring(content.cast("string"), 1, 64)
    return (F.length(text) > 0) & ~text.startswith("<") & (text.startswith("TradDt") | text.contains(","))


def _records(content: str | None) -> list[list[str]]:
    """Records of a CSV text with their fields; quoted fields may hold commas, quotes and line ends.  Blank records are left out."""
    csv.field_size_limit((1 << 31) - 1)
    return [r for r in csv.reader(io.StringIO(content or "", newline="")) if any(f.strip() for f in r)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def records(content: pd.Series) -> pd.Series:
    return content.map(_records)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files as fields, with file and position, blank ones left out."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), records("value").alias("records"))
    return whole.select("file", F.posexplode("records").alias("at", "fields"))


def rows_by_header(lines: DataFrame) -> DataFrame:
    """file, at and a map from header to field; records of another width than their file's header are left out."""
    header = lines.where("at = 0").select("file", F.col("fields").alias("header"))
    joined = lines.where("at > 0").join(header, "file").where(F.size("fields") == F.size("header"))
    return joined.select("file", "at", F.map_from_arrays(F.transform("header", F.trim), "fields").alias("row"))


def layout(row: Column) -> Column:
    """"new", "legacy" or "unknown", by the header."""
    has = lambda name: F.map_contains_key(row, F.lit(name))
    return F.when(has("TradDt") | has("FinInstrmId"), "new").when(has("SYMBOL") & has("TIMESTAMP"), "legacy").otherwise("unknown")


def typed_prices(rows: DataFrame) -> DataFrame:
    """The typed columns of price rows; numbers that can't be read are null, a missing text is empty; rows without a date are dropped."""
    out = []
    for head, (name, kind) in PRICE_COLUMNS.items():
        raw = F.trim(F.try_element_at("row", F.lit(head)))
        value = F.coalesce(raw, F.lit("")) if kind == "string" else raw.try_cast("double").cast("bigint") if kind == "bigint" else raw.try_cast("double")
        out.append(value.alias(name))
    return rows.select("file", "at", *out).where("trade_date <> ''")


def legacy_date(c: Column) -> Column:
    """2-JAN-2006 as 2006-01-02; an unknown month is 00, anything else stays."""
    month = F.coalesce(F.try_element_at(F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m.upper()), F.lit(f"{i + 1:02d}"))]), F.upper(F.regexp_extract(c, r"^\d{1,2}-([A-Za-z]{3})-\d{4}$", 1))), F.lit("00"))
    parts = r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$"
    return F.when(c.rlike(parts), F.concat_ws("-", F.regexp_extract(c, parts, 3), month, F.lpad(F.regexp_extract(c, parts, 1), 2, "0"))).otherwise(c)


def legacy_prices(rows: DataFrame) -> DataFrame:
    """The typed columns of price rows of the older layout; numbers that can't be read are null, a missing text is empty; rows without a date are dropped."""
    out = []
    for head, (name, kind) in LEGACY_PRICE_COLUMNS.items():
        raw = F.trim(F.try_element_at("row", F.lit(head)))
        out.append((F.coalesce(raw, F.lit("")) if kind == "string" else raw.try_cast("double")).alias(name))
    return rows.select("file", "at", *out).where("trade_date <> ''").withColumn("trade_date", legacy_date(F.col("trade_date")))


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of price files of both layouts, with their layout; columns that the older one lacks are null, files of an unknown layout give no row."""
    rows = rows_by_header(read_lines(spark, path)).withColumn("layout", layout(F.col("row")))
    new, legacy = (f(rows.where(F.col("layout") == kind)).withColumn("layout", F.lit(kind)) for kind, f in (("new", typed_prices), ("legacy", legacy_prices)))
    return new.unionByName(legacy, allowMissingColumns=True)


def business_days(spark: SparkSession, day: str, n: int) -> DataFrame:
    """The n weekdays up to a day, latest first."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(day).cast("date"), 2 * n + 4), F.lit(day).cast("date"))).alias("day"))
    return days.where(F.weekday("day") < 5).orderBy(F.desc("day")).limit(n)


def price_file_url(day: Column) -> Column:
    """Where the exchange keeps the price file of a day."""
    url = F.when(day < F.lit(PRICE_FILE_CHANGE).cast("date"), PRICE_FILE_OLD).otherwise(PRICE_FILE_NEW)
    for name, pattern in (("{year}", "yyyy"), ("{MON}", "MMM"), ("{month}", "MM"), ("{day}", "dd")):
        url = F.replace(url, F.lit(name), F.upper(F.date_format(day, pattern)))
    return url


def price_history(spark: SparkSession, start: str, end: str) -> DataFrame:
    """day and url of the price files of all weekdays from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.where(F.weekday("day") < 5).select("day", price_file_url(F.col("day")).alias("url"))


def first_good_day(files: DataFrame) -> DataFrame:
    """The latest day of (day, content) whose content looks like a CSV file."""
    return files.where(F.coalesce(looks_like_csv(F.col("content")), F.lit(False))).agg(F.max_by(F.struct("day", "content"), "day").alias("x")).where("x is not null").select("x.*")


def rows_of_contents(files: DataFrame) -> DataFrame:
    """file, at and row (a map by header) of CSV contents held in a column, as :func:`rows_by_header` gives them for files."""
    lines = files.select("file", F.posexplode(records(F.col("content"))).alias("at", "fields"))
    return rows_by_header(lines)


def prices_in_texts(docs: DataFrame, modules: list[str]) -> DataFrame:
    """Rows of the price files that documents of some modules hold as their text (file is the document's id)."""
    wanted = docs.where(F.lower("module").isin(modules) & F.coalesce(looks_like_csv(F.col("text")), F.lit(False)))
    return rows_of_contents(wanted.select(F.col("unique_id").alias("file"), F.col("text").alias("content")))


def price_file_documents(files: DataFrame, module: str, title: str) -> DataFrame:
    """Price files (day, url, content) as documents: the whole file is the text; files that are no CSV are left out."""
    good = files.where(F.coalesce(looks_like_csv(F.col("content")), F.lit(False)))
    day = F.date_format("day", "yyyy-MM-dd")
    return good.select(F.lit(module).alias("module"), F.concat(F.lit(title + " "), day).alias("title"), "url", F.concat(F.lit(module + "_"), day).alias("unique_id"), day.alias("publish_date"), F.unix_seconds(F.col("day").cast("timestamp")).alias("publish_date_ms"), F.col("content").alias("text"))
