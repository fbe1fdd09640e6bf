"""Entity co-occurrence: pairs in a document, edge weights, node labels, GEXF export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_name, xml_escape


def entity_id(entity: Column) -> Column:
    return F.coalesce(entity["entity_id"], F.concat(F.lit("name:"), norm_name(entity["surface_form"])))


def document_pairs(mentions: DataFrame, doc: str = "doc_id", node: str = "entity_id") -> DataFrame:
    """(doc, src, dst) for each pair of different entities of a document, src before dst."""
    m = mentions.select(doc, node).where(F.col(node).isNotNull()).distinct()
    ids = m.groupBy(doc).agg(F.array_sort(F.collect_set(node)).alias("ids")).where(F.size("ids") > 1)
    first = ids.select(doc, "ids", F.posexplode("ids").alias("k", "src"))
    return first.select(doc, "src", F.explode(F.slice("ids", F.col("k") + 2, F.size("ids"))).alias("dst"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """Sum of the weights of each pair."""
    return edges.groupBy("src_entity_id", "dst_entity_id").agg(F.sum("weight").alias("weight"))


def node_labels(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Every node of the edges with the entity's name, or its id where there is none."""
    nodes = edges.select(F.col("src_entity_id").alias("entity_id")).unionByName(edges.select(F.col("dst_entity_id").alias("entity_id"))).distinct()
    return nodes.join(entities.select("entity_id", "canonical_name"), "entity_id", "left").select("entity_id", F.coalesce("canonical_name", "entity_id").alias("label"))


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A GEXF 1.3 document as ordered lines (section, position, line); write them sorted to one text file."""
    text = lambda s: F.lit(s)
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="undirected">', "<nodes>"]
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, f"{i:04d}", s) for i, s in enumerate(head)] + [(2, "0", "</nodes>"), (2, "1", "<edges>"), (4, "0", "</edges>"), (4, "1", "</graph>"), (4, "2", "</gexf>")], "section int, position string, line string")
    weight = F.regexp_replace(F.col("weight").cast("double").cast("string"), r"\.0$", "")
    body = nodes.select(F.lit(1).alias("section"), F.col("entity_id").alias("position"), F.concat(text('<node id="'), xml_escape(F.col("entity_id")), text('" label="'), xml_escape(F.col("label")), text('"/>')).alias("line"))
    pairs = edges.select(F.lit(3).alias("section"), F.concat_ws("|", "src_entity_id", "dst_entity_id").alias("position"), F.concat(text('<edge source="'), xml_escape(F.col("src_entity_id")), text('" target="'), xml_escape(F.col("dst_entity_id")), text('" weight="'), weight, text('"/>')).alias("line"))
    return frame.unionByName(body).unionByName(pairs)
