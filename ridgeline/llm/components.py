"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches.

    Each step takes the smallest label of the neighbours and then the label of one's label, so that the number of steps grows with the
    logarithm of the longest path. Labels are written out after each step. A hub's edges are summed before they are sent.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = cut(step.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        discard(labels)
        labels = step.select("node", "label")
        labels._cut_at = step._cut_at
        if not step.filter("label <> old").limit(1).count():
            discard(both)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) with the components joined that further links (a, b) tie together; nodes without a label stand for themselves."""
    name = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}l"))
    edges = cut(links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("al", "a").alias("a"), F.coalesce("bl", "b").alias("b")).filter("a <> b"))
    over = components(edges)
    nodes = labels.union(over.select("node", "node")).toDF("node", "label").groupBy("node").agg(F.min("label").alias("label"))
    out = cut(nodes.join(over.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")))
    discard(edges)
    return out
