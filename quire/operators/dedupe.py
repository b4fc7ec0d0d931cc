"""Exact duplicates, duplicates through references, unused items and sizes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans import closure
from quire.plans.checkpoints import cut


def duplicate_groups(items: DataFrame, by: str = "hash") -> DataFrame:
    """Per content hash with copies: the id kept, how many copies go and the bytes they take."""
    groups = items.groupBy(by).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b"), F.min("bytes").alias("_one"))
    return groups.where("_n > 1").select(by, "keep_id", (F.col("_n") - 1).alias("duplicates"), (F.col("_b") - F.col("_one")).alias("bytes_saved"))


def dedupe_exact(items: DataFrame, by: str = "hash") -> DataFrame:
    """Every item with the id that stands for it. Only hashes with copies are joined back."""
    kept = duplicate_groups(items, by).select(by, "keep_id")
    return items.join(kept, by, "left").withColumn("keep_id", F.coalesce("keep_id", "id"))


def dedupe_refs(items: DataFrame, refs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Duplicates that show only after what they refer to has merged: `(id, keep_id)` for items that went.

    `items (id, hash)`, `refs (id, slot, target)`. An item is described by its content and by two
    independent 64-bit sums over its (slot, target) pairs, so no item's references are ever listed. Rounds go on
    until nothing more merges, or for `rounds` of them.
    """
    alive, links = items.select("id", "hash"), refs.select("id", "slot", "target")
    merged: DataFrame | None = None
    for _ in count() if rounds is None else range(rounds):
        sums = links.groupBy("id").agg(
            F.sum(F.xxhash64("slot", "target").cast("decimal(38,0)")).alias("_a"),
            F.sum(F.xxhash64(F.lit(7), "target", "slot").cast("decimal(38,0)")).alias("_b"),
        )
        described = alive.join(sums, "id", "left").na.fill({"hash": ""})
        shape = ["hash", F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b")]
        described = described.select("id", *shape)
        groups = described.groupBy("hash", "_a", "_b").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        found = cut(described.join(groups, ["hash", "_a", "_b"]).where("id <> keep_id").select("id", "keep_id"))
        if found.isEmpty():
            break
        turn = found.select(F.col("id").alias("target"), F.col("keep_id").alias("_to"))
        alive = cut(alive.join(found, "id", "left_anti"))
        links = cut(links.join(found, "id", "left_anti").join(turn, "target", "left")
                    .select("id", "slot", F.coalesce("_to", "target").alias("target")))
        if merged is None:
            merged = found
        else:
            later = found.select(F.col("id").alias("keep_id"), F.col("keep_id").alias("_to"))
            merged = cut(merged.join(later, "keep_id", "left").select("id", F.coalesce("_to", "keep_id").alias("keep_id")).unionByName(found))
    return merged if merged is not None else items.sparkSession.createDataFrame([], items.select("id", F.col("id").alias("keep_id")).schema)


def unused(items: DataFrame, refs: DataFrame, roots: DataFrame) -> DataFrame:
    """Items no root reaches. `refs (src, dst)`, `roots (node)`."""
    used = closure.reachable(refs, roots).select(F.col("node").alias("id"))
    return items.join(used, "id", "left_anti")


def downsample_candidates(placements: DataFrame, target: float, threshold: float = 1.5) -> DataFrame:
    """Images whose lowest shown resolution over all placements is well above the target."""
    wide = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")) / 72
    high = F.sqrt(F.col("c") * F.col("c") + F.col("d") * F.col("d")) / 72
    shown = placements.where("pixel_width > 0 and pixel_height > 0").withColumns({"_w": wide, "_h": high}).where("_w >= 1e-6 and _h >= 1e-6")
    ppi = F.least(F.col("pixel_width") / F.col("_w"), F.col("pixel_height") / F.col("_h"))
    lowest = shown.groupBy("doc_id", "image_id").agg(F.min(ppi).alias("ppi"), F.count(F.lit(1)).alias("placements"))
    return lowest.where(F.col("ppi") > target * threshold)


def size_report(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Original and result size, items removed and merged, and what is left, per document."""
    old = before.groupBy(key).agg(F.sum("bytes").alias("original"), F.count(F.lit(1)).alias("items"))
    new = after.groupBy(key).agg(F.sum("bytes").alias("result"), F.count(F.lit(1)).alias("left"))
    both = old.join(new, key, "left").na.fill(0, ["result", "left"])
    return both.select(
        key, "original", "result", (F.col("items") - F.col("left")).alias("removed"),
        F.when(F.col("original") > 0, F.col("result") / F.col("original")).otherwise(1.0).alias("ratio"),
    )
