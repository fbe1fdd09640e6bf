"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo; a null key is the empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def totals(labels: DataFrame, label: str, learn: Column) -> tuple[int, int]:
    """Documents with label 0 and 1 among the rows to learn from."""
    row = _known(labels, label, learn).agg(F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1))).first()
    return int(row[0]), int(row[1])


def _known(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, text: str = "text") -> DataFrame:
    """text and label of at most ``bound`` labelled documents, chosen by a hash of their ids.

    Where a document has several labels the larger counts, of several texts with
    one id the least, so an id is one row however often it occurs.
    """
    # The sample's size is bounded by the parameter, so it can be broadcast.
    chosen = F.broadcast(_known(labels, label, learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    texts = documents.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")
