"""Relational sinks: first-wins and last-wins upserts, fact tables, run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows and those new ones whose key is new; of several the first by ``order``.

    A key with a null in it equals no other, so all such rows are kept.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    cols = [c for c in new.columns if c not in keys]
    first = new.where(known).groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in cols])
    fresh = first.join(existing.select(*keys).distinct(), keys, "left_anti").unionByName(new.where(~known))
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace existing ones with their key; of several the last by ``order``."""
    cols = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in cols])
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*existing.columns))


def facts(df: DataFrame, kind: str, doc: str = "doc_id") -> DataFrame:
    """A row for each element of an array of structs."""
    return df.select(doc, F.explode(kind).alias("__x")).select(doc, "__x.*")


def emit_tables(df: DataFrame, doc: str = "doc_id") -> dict[str, DataFrame]:
    """The fact tables of an enriched document table, by name, for the arrays that it has."""
    names = {"amounts": "amounts", "counts": "counts", "dates_referenced": "dates_ref", "themes": "themes", "gcam": "gcam", "locations": "locations", "organizations": "entity_mentions"}
    return {table: facts(df, column, doc) for column, table in names.items() if column in df.columns}


def gcam(tone: Column) -> Column:
    """The tone panel as rows of a dictionary table."""
    row = lambda dim, key, score: F.struct(F.lit("finlex").alias("dict_id"), F.lit(dim).alias("dim_id"), F.lit(key).alias("key"), score.cast("double").alias("score"))
    return F.array(row("wc", "c", tone["word_count"]), row("tone", "v", tone["tone"]), row("pos", "v", tone["positive"]), row("neg", "v", tone["negative"]), row("act", "v", tone["activity"]))


def should_skip(feeds: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """Feeds (source, dataset, frequency_days) with skip: the last success is less than the frequency ago; a frequency of 0 never skips."""
    joined = feeds.join(ledger.select("source", "dataset", "last_success_ts"), ["source", "dataset"], "left")
    return joined.select("source", "dataset", (F.col("frequency_days") > 0).__and__(F.coalesce(now - F.col("last_success_ts") < F.col("frequency_days") * 86400, F.lit(False))).alias("skip"))


def record_results(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger after attempts (source, dataset, ts, ok, rows, message): a failure keeps the last success."""
    r = results.select("source", "dataset", "ts", "ok", "rows", F.col("message").alias("new_message"))
    both = ledger.join(r, ["source", "dataset"], "full")
    tried = F.col("ts").isNotNull()
    return both.select(
        "source",
        "dataset",
        F.coalesce("ts", "last_attempt_ts").alias("last_attempt_ts"),
        F.when(F.col("ok"), F.col("ts")).otherwise(F.col("last_success_ts")).alias("last_success_ts"),
        F.when(tried, F.when(F.col("ok"), "success").otherwise("failed")).otherwise(F.col("status")).alias("status"),
        F.when(tried, F.col("rows")).otherwise(F.col("rows_ingested")).alias("rows_ingested"),
        F.when(tried, F.col("new_message")).otherwise(F.col("message")).alias("message"),
    )
