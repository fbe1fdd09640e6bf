"""The registered queries of this subpackage: thin digests of what its operators give."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_labeller, decontaminate, labelled, mpeg_audio, piece_bpe, quality, simhash, token_counts, token_shards, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.digests(mpeg_audio.media_table(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_shards.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return found.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_labeller.main_text(table(spark, sf_dir, "pages"))


#: Scores from which a document counts as toxic, and as good.
TOXIC, GOOD = 0.3, 0.5


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from labelled documents whose crc32 remainder by 4 is not 2."""
    learn = labelled.remainder("doc_id", 4) != 2
    return toxicity.learn(labelled.sample(documents, labels, "toxic", learn, toxicity.SAMPLE), *labelled.totals(labels, "toxic", learn))


def quality_model(documents: DataFrame, labels: DataFrame):
    """Fitted to labelled documents whose crc32 remainder by 3 is not 1."""
    return quality.fit_forest(labelled.sample(documents, labels, "quality", labelled.remainder("doc_id", 3) != 1, quality.SAMPLE))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity_model(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (labelled.remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = quality.score(documents, quality_model(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (labelled.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mpeg_audio, op2_decontamination, op3_token_counts, op4_token_shards, op5_simhash, op6_warc, op7_sentencepiece, op8_html_extraction, op9_toxicity, op10_quality)
}

ORACLES: dict[str, str] = {
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM win),
        dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
        hit AS (SELECT dw.r, dw.i, dw.k, win.item_id FROM dw JOIN win USING (k, s)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
        x AS (SELECT page_id, h, top, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits
              FROM p JOIN g USING (h))
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM x""",
}
