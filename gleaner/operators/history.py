"""Versions of documents: the one before, by title or by path, and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def previous_versions(docs: DataFrame, same: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Each document with ``previous``, a struct of the ``keep`` columns of the one before it among those that agree in ``same``; null for the first."""
    before = Window.partitionBy(*same).orderBy(*order)
    return docs.withColumn("previous", F.lag(F.struct(*keep)).over(before))


def previous_by_path(docs: DataFrame, stored: DataFrame, path: str = "$.previous_circular_file", column: str = "generated_content") -> DataFrame:
    """Each document with ``previous_text``: the text of the stored document (filename, text) whose path its generated content names; null without one."""
    name = path.removeprefix("$.")
    named = docs.withColumn("__path", F.try_element_at(column, F.lit(name)))
    return named.join(stored.select(F.col("filename").alias("__path"), F.col("text").alias("previous_text")).dropDuplicates(["__path"]), "__path", "left").drop("__path")


def changed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose white-space-free text differs from that of their previous version; first versions don't count."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return docs.where(F.col("previous").isNotNull() & (bare(F.col(text)) != bare(F.col(f"previous.{text}"))))


def next_version(rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    """key and the highest version of its rows, 0 where there is none."""
    return rows.groupBy(key).agg(F.coalesce(F.max(version), F.lit(0)).alias("version"))
