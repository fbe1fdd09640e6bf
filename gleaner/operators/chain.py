"""Document processors as DataFrame functions, their registry, and chains of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as d
from ..functions import extract, text
from ..functions.hashing import document_id
from . import chunk, classify, dedupe, graph, store

Processor = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Processor] = {}


def processor(name: str):
    def register(f: Processor) -> Processor:
        REGISTRY[name] = f
        return f

    return register


@dataclass(frozen=True)
class Plugin:
    name: str
    enabled: bool = True
    kind: str = "data_processor"
    priority: int = 0
    params: dict = field(default_factory=dict)


def plan(plugins: list[Plugin]) -> list[str]:
    """Names of the enabled processors that exist, by priority and then by name."""
    return [p.name for p in sorted(plugins, key=lambda p: (p.priority, p.name)) if p.enabled and p.kind == "data_processor" and p.name in REGISTRY]


def run_chain(documents: DataFrame, plugins: list[Plugin]) -> DataFrame:
    """One lazy plan of all processors in order."""
    return reduce(lambda df, name: df.transform(REGISTRY[name]), plan(plugins), documents)


def _when_long(least: int, value, empty):
    return F.when(F.octet_length("text") >= least, value).otherwise(empty)


@processor("dedupe")
def near_duplicates(df: DataFrame) -> DataFrame:
    """Canonical URLs, and duplicate_of for near copies of earlier documents (by unique_id)."""
    tagged = dedupe.tag_duplicates(df, "unique_id").select("unique_id", "duplicate_of").dropDuplicates(["unique_id"])
    return df.withColumn("url", text.canonical_url(F.col("url"))).join(tagged, "unique_id", "left")


@processor("mentions")
def mentions(df: DataFrame) -> DataFrame:
    """doc_id, cluster_id, quick tone and words of documents of at least 80 bytes."""
    own = document_id(F.col("unique_id"), F.col("url"))
    copy = F.trim(F.coalesce(F.col("duplicate_of").cast("string"), F.lit(""))) if "duplicate_of" in df.columns else F.lit("")
    df = df.withColumn("doc_id", own).withColumn("cluster_id", F.when(copy != "", copy).otherwise(own))
    return df.withColumn("quick_tone", _when_long(80, text.quick_tone(F.col("text"), d.QUICK_POSITIVE, d.QUICK_NEGATIVE), None)).withColumn("word_count", F.size(text.tokens(F.col("text"))).cast("long"))


@processor("extract_quant")
def quantities(df: DataFrame) -> DataFrame:
    return extract.with_extracts(df, ["amounts", "counts", "dates_referenced"])


@processor("themes")
def themes(df: DataFrame) -> DataFrame:
    return df.withColumn("themes", text.themes(F.col("text"), d.THEMES))


@processor("tone")
def tone(df: DataFrame) -> DataFrame:
    panel = df.withColumn("tone", _when_long(40, text.tone_panel(F.col("text"), d.POSITIVE, d.NEGATIVE, d.ACTIVE), None))
    return panel.withColumn("gcam", F.when(F.col("tone").isNotNull(), store.gcam(F.col("tone"))))


@processor("geocode")
def geocode(df: DataFrame) -> DataFrame:
    return df.withColumn("locations", text.places(F.col("text"), d.PLACES))


@processor("ner")
def organisations(df: DataFrame) -> DataFrame:
    """Organisations and the distinct names in order."""
    found = extract.with_extracts(df, ["organizations"])
    return found.withColumn("all_names", F.array_distinct(F.transform("organizations", lambda o: o["surface_form"])))


@processor("filter")
def wanted(df: DataFrame) -> DataFrame:
    return classify.keep_wanted(df)


@processor("split_text")
def split_text(df: DataFrame) -> DataFrame:
    """text_parts from semantic chunks, one struct (id, text) each."""
    chunks = chunk.chunk_table(df.select("unique_id", "text").dropDuplicates(["unique_id"]), "unique_id")
    parts = chunks.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_index").alias("id"), F.col("chunk_text").alias("text")))).alias("text_parts"))
    return df.drop("text_parts").join(parts, "unique_id", "left")


def mention_rows(df: DataFrame) -> DataFrame:
    """The mentions table: source is the first source name, else the module."""
    source = F.coalesce(F.try_element_at("source_name", F.lit(1)), F.col("module"))
    return df.where(F.octet_length("text") >= 80).select("cluster_id", "doc_id", F.col("publish_date_ms").alias("mention_ts"), source.alias("source"), F.lit(100.0).alias("confidence"))


def entity_edges(df: DataFrame) -> DataFrame:
    """Co-occurrence edges of the organisations of each document."""
    ids = df.select("doc_id", F.explode(F.transform("organizations", graph.entity_id)).alias("entity_id"))
    pairs = graph.document_pairs(ids)
    return pairs.select("doc_id", F.col("src").alias("src_entity_id"), F.col("dst").alias("dst_entity_id"), F.lit("cooccur").alias("edge_type"), F.lit(1.0).alias("weight"))


def entities(df: DataFrame) -> DataFrame:
    """One provisional row for each organisation: the first surface form by document."""
    each = df.select("doc_id", F.explode("organizations").alias("o")).select("doc_id", graph.entity_id(F.col("o")).alias("entity_id"), F.col("o.surface_form").alias("name"), F.col("o.char_offset").alias("at"))
    return each.groupBy("entity_id").agg(F.min_by("name", F.struct("doc_id", "at")).alias("canonical_name")).withColumn("status", F.lit("provisional"))
