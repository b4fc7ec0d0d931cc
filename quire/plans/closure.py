"""Following references: roots of chains, and everything reachable from some rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.checkpoints import cut


# Rounds after which what was seen is written as one table, so a deep graph keeps a short plan.
FLATTEN_EVERY = 8


def chain_ends(links: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Where each chain of links `(keys, node, parent, parent_ends)` leads, within `limit` steps if one is given.

    `parent_ends` says the parent is not itself linked on. Returns `(keys, node, root, hops)`. Chains that
    loop or break off are left out, as are those longer than the limit. Each round doubles the distance walked,
    and only the chains that have not ended are joined again: what is still open after as many steps as its
    group has links is a loop.
    """
    keys = list(keys)
    table = cut(links.select(
        *keys, "node", F.col("parent").alias("root"), F.lit(1).cast("long").alias("hops"), F.col("parent_ends").alias("_done")))
    longest = limit
    if longest is None:
        longest = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    walked = 1
    while walked < longest:
        open_ = table.where("not _done")
        if open_.isEmpty():
            break
        ahead = table.select(*keys, F.col("node").alias("root"), F.col("root").alias("_root"), F.col("hops").alias("_hops"), F.col("_done").alias("_d"))
        moved = open_.drop("_done").join(ahead, [*keys, "root"]).select(
            *keys, "node", F.col("_root").alias("root"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_d").alias("_done"))
        within = moved if limit is None else moved.where(F.col("hops") <= limit)
        table = cut(within.unionByName(table.where("_done")))
        walked *= 2
    return table.where("_done").drop("_done")


def reachable(refs: DataFrame, roots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The nodes `(keys, node)` that `roots` reach over `refs (keys, src, dst)`, the roots included, with their distance."""
    keys = list(keys)
    edges = refs.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_next")).distinct()
    seen = cut(roots.select(*keys, "node").distinct().withColumn("distance", F.lit(0).cast("long")))
    frontier, distance = seen, 0
    while not frontier.isEmpty():
        distance += 1
        found = frontier.select(*keys, "node").join(edges, [*keys, "node"]).select(*keys, F.col("_next").alias("node")).distinct()
        frontier = cut(found.join(seen, [*keys, "node"], "left_anti").withColumn("distance", F.lit(distance).cast("long")))
        seen = seen.unionByName(frontier)
        if distance % FLATTEN_EVERY == 0:
            seen = cut(seen)
    return seen
