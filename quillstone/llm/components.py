"""Connected components of a graph of links, by label propagation with pointer jumping over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import scratch, settle, to_rows


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the least node of its component.

    Each round takes the least label among a node's neighbours, then the label of that label; a star settles in two
    rounds, a path of n nodes in about log n. Links of a hub are met in parts and pre-aggregated
    before the shuffle.
    """
    with scratch(links.sparkSession) as keep:
        both = settle(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))), "cc-links")
        labels = settle(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "cc-labels")
        while True:
            near = to_rows(both, labels.select(F.col("node").alias("other"), "label"), "other", F.xxhash64("node"), 512).groupBy("node").agg(F.min("label").alias("near"))
            lowered = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
            jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
            moved = settle(lowered.join(jump, "low", "left").select("node", F.least("low", "far").alias("label"), "was"), "cc-labels")
            labels = moved.select("node", "label")
            if not moved.where("label != was").limit(1).count():
                keep(moved)
                return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) with more links (a, b): the components of the labels that they join are found, not those of all nodes again."""
    named = links.select("a", "b")
    for end in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    named = settle(named, "cc-named")
    joined = components(named.where("of_a != of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    nodes = labels.union(named.select("a", "of_a")).union(named.select("b", "of_b")).distinct()
    now = nodes.select("label").distinct().join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
    return settle(to_rows(nodes, now.select("label", F.coalesce("least", "label").alias("least")), "label", F.xxhash64("node")).select("node", F.col("least").alias("label")), "cc-labels")
