"""A pipeline from raw documents to token ids, made of five of the library's operators.

Each stage takes (spark, docs, sf_dir); all but the last give back documents
with the columns that they got.  :func:`run` writes each stage's result as
Parquet to shared storage and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, piece_bpe, quality, queries, simhash, toxicity
from gleaner.llm.workspace import stored


def _apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents under column names that clash with none of an operator's, and the name of the text among them."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to labelled ones among them, doesn't reject."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    apart, text = _apart(docs)
    return _back(quality.score(apart, model, text, tuple(apart.columns)).where(F.col("score") >= queries.GOOD), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    apart, text = _apart(docs)
    return _back(toxicity.score(apart, model, text, tuple(apart.columns)).where(F.col("score") < queries.TOXIC), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id.  Rows without an id rank after all others, by a hash of their text."""
    spare = (F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))).cast("long")
    marked = docs.withColumn("__id", F.coalesce(F.col("doc_id"), spare))
    groups = simhash.near_duplicates(marked.select(F.col("__id").alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    return marked.join(first, "__id", "left_semi").dropDuplicates(["__id"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item's windows in 5 % of their words or more."""
    apart, text = _apart(docs)
    found = decontaminate.contamination(apart, queries.table(spark, sf_dir, "benchmark"), text, tuple(apart.columns))
    return _back(found.where(~F.col("contaminated")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the text decoded from them."""
    return piece_bpe.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the classifiers, XXH64 or the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
