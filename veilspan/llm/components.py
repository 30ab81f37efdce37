"""Connected components of a table of links, by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import cut_few, joined

MOST_ROUNDS = 40


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node of its component) of every node that has an edge.

    In each round a node takes the least label among its own and its neighbours', and then its label's label (pointer
    jumping), so that rounds grow with the logarithm of a component's width. Neighbours' labels are pre-aggregated before
    the shuffle; a node with very many edges and a label of very many nodes are dealt into pieces. Nothing but the number of
    changed labels comes to the driver.
    """
    both = cut_few(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).where("node <> other").distinct())
    links = both.count()
    labels = cut_few(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    nodes = labels.count()
    for _ in range(MOST_ROUNDS):
        near = joined(both, labels.select(F.col("node").alias("other"), "label"), "other", total=links).groupBy("node").agg(F.min("label").alias("near"))
        step = cut_few(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = joined(step, jump, "label", how="left", total=nodes).select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old")
        step = cut_few(step)
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
