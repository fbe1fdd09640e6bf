"""Near-duplicate tagging: each document within 3 bits of an earlier representative is its duplicate.

Documents with equal fingerprints behave alike, so the search runs on distinct
fingerprints, each with its first document.  Pairs within the radius come from
buckets of two equal segments of five; nothing is compared beyond those.  The
greedy rule (a document is a representative iff no earlier representative is
within the radius) is settled block by block in the documents' order, each block
as large as all before it: fingerprints near an earlier block's representative
leave at once, and only the others of a block are paired with each other.  So a
family of n near copies costs about n times its representatives, not n squared.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming, with_simhash

LEAST_BYTES, RADIUS = 200, 3
#: Fingerprints of the first block of the greedy rule, and keys of a sample that finds the other blocks' ends.
LEAST_BLOCK, SAMPLE = 16384, 1024
_SEGMENTS = [((1 << 13) - 1) << (13 * k) if k < 4 else ((1 << 64) - 1) ^ ((1 << 52) - 1) for k in range(5)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and simhash of texts of at least 200 bytes."""
    long_enough = documents.where(F.octet_length(text) >= LEAST_BYTES).select(key, F.col(text).alias("text"))
    return with_simhash(long_enough).select(key, "simhash")


def _firsts(marked: DataFrame, key: str) -> DataFrame:
    return marked.groupBy("simhash").agg(F.min(key).alias("first"))


def _banded(nodes: DataFrame) -> DataFrame:
    masks = [_signed(a | b) for a, b in combinations(_SEGMENTS, 2)]
    spread = F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "part")
    return nodes.select("simhash", "first", spread)


def _close(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """Rows l and r of one bucket within the radius, l the earlier."""
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.first") < F.col("r.first"))
    return _banded(left).alias("l").join(_banded(right).alias("r"), same).where(hamming(F.col("l.simhash"), F.col("r.simhash")) <= radius)


def near_pairs(marked: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of fingerprints within the radius, with their first documents; a's is the earlier."""
    return _node_pairs(_firsts(marked, key), radius)


def _node_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    close = _close(nodes, nodes, radius)
    return close.select(F.col("l.simhash").alias("a"), F.col("l.first").alias("first_a"), F.col("r.simhash").alias("b"), F.col("r.first").alias("first_b")).distinct()


def block_ends(nodes: DataFrame, least: int) -> list:
    """Ascending values of ``first`` that end blocks: the first block has about ``least`` rows, each other as many as all before it.

    They are read from samples of at most 1024 keys and only decide how the work is cut up, never a result.
    """
    ends, size = [], nodes.count()
    while size > least:
        sample = [r["first"] for r in nodes.select("first").orderBy(F.xxhash64("first")).limit(SAMPLE).orderBy("first").collect()]
        halvings = min(6, max(1, math.ceil(math.log2(size / least))))
        ends += [sample[max(len(sample) >> k, 1) - 1] for k in range(1, halvings + 1)]
        nodes, size = nodes.where(F.col("first") <= F.lit(ends[-1])), size >> halvings
    return list(dict.fromkeys(reversed(ends)))


def leaders(marked: DataFrame, key: str = "doc_id", radius: int = RADIUS, least: int = LEAST_BLOCK) -> DataFrame:
    """(node, leader) for first documents of fingerprints that have an earlier representative, their least one.  Rows without a key have none."""
    nodes = _firsts(marked, key).where("first is not null").checkpoint()
    ends = block_ends(nodes, least)
    found, kept = [], []
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        block = nodes if low is None else nodes.where(F.col("first") > F.lit(low))
        block = block if high is None else block.where(F.col("first") <= F.lit(high))
        if kept:
            old = _close(union_all(kept), block, radius).groupBy(F.col("r.first").alias("node")).agg(F.min("l.first").alias("leader")).checkpoint()
            block = block.join(old.select(F.col("node").alias("first")), "first", "left_anti").checkpoint()
            found.append(old)
        new = greedy_representatives(_node_pairs(block, radius)).checkpoint()
        found.append(new)
        kept.append(block.join(new.select(F.col("node").alias("first")), "first", "left_anti").checkpoint())
    return union_all(found)


def greedy_representatives(pairs: DataFrame) -> DataFrame:
    """(node, leader) for the later nodes of pairs (first_a, first_b) that have an earlier representative, their least one.

    Each round decides every node all of whose earlier neighbours are decided;
    the rounds are as many as the longest chain needs, and each is checkpointed.
    """
    edges = pairs.select(F.col("first_a").alias("i"), F.col("first_b").alias("j")).distinct().checkpoint()
    decided = edges.select(F.col("i").alias("node")).unionByName(edges.select(F.col("j").alias("node"))).distinct()
    decided = decided.join(edges.select(F.col("j").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(True).alias("rep")).checkpoint()
    while True:
        state = edges.join(decided.select(F.col("node").alias("i"), "rep"), "i", "left")
        open_ = state.join(decided.select(F.col("node").alias("j")), "j", "left_anti")
        news = open_.groupBy("j").agg(F.max(F.coalesce("rep", F.lit(False))).alias("taken"), F.sum(F.when(F.col("rep").isNull(), 1).otherwise(0)).alias("waiting"))
        news = news.where("taken or waiting = 0").select(F.col("j").alias("node"), (~F.col("taken")).alias("rep")).checkpoint()
        if news.isEmpty():
            break
        decided = decided.unionByName(news).checkpoint()
    leaders = edges.join(decided.where("rep").select(F.col("node").alias("i")), "i").groupBy("j").agg(F.min("i").alias("leader"))
    return leaders.join(decided.where("rep").select(F.col("node").alias("j")), "j", "left_anti").select(F.col("j").alias("node"), "leader")


def tag_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and duplicate_of (null for representatives and for texts that are too short)."""
    marked = fingerprints(documents, key, text).checkpoint()
    by_print = _firsts(marked, key).join(leaders(marked, key).withColumnRenamed("node", "first"), "first", "left").select("simhash", "first", "leader")
    tagged = marked.join(by_print, "simhash").select(key, F.coalesce("leader", F.when(F.col(key) != F.col("first"), F.col("first"))).alias("duplicate_of"))
    return documents.select(key).join(tagged, key, "left")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Everything from several sources, duplicates included."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
