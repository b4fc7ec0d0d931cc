"""Connected components of links by least labels, with rounds staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common


def components(links: DataFrame) -> DataFrame:
    """`(node, root)` for every node of `links (a, b)`: the least node it is connected with.

    Each round takes the least label among the neighbours and then the label's own label, so long chains halve. Minima
    are combined before the shuffle, so a node with very many links is no hot key.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    edges = common.staged(both, "edges")
    labels = common.staged(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        seen = edges.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "root").union(labels)
        least = seen.groupBy("node").agg(F.min("root").alias("root"))
        ahead = labels.select(F.col("node").alias("root"), F.col("root").alias("_ahead"))
        old = labels.select("node", F.col("root").alias("_old"))
        moved = least.join(ahead, "root", "left").join(old, "node").select("node", F.least("root", F.coalesce("_ahead", "root")).alias("root"), "_old")
        moved = common.staged(moved, "labels")
        changed = not moved.where("root <> _old").isEmpty()
        labels = moved.select("node", "root")
        if not changed:
            return labels
