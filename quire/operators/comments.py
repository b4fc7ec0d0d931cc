"""Comment threads and review states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans import blocks, closure

# ---- fixed values
REVIEW = "review"
# -----------------


def _is_reply():
    return F.col("reply_to").isNotNull() & (F.col("reply_type").isNull() | (F.col("reply_type") == "R"))


def thread_roots(comments: DataFrame, max_depth: int | None = None) -> DataFrame:
    """For each reply `(doc_id, id, reply_to, reply_type)` the comment its thread starts at.

    Replies in a loop or under a missing comment have no thread, nor have those deeper than `max_depth` if it is given.
    """
    flagged = comments.select("doc_id", "id", "reply_to", _is_reply().alias("_reply"))
    parents = flagged.select("doc_id", F.col("id").alias("reply_to"), (~F.col("_reply")).alias("parent_ends"))
    links = flagged.where("_reply").join(parents, ["doc_id", "reply_to"]).select("doc_id", F.col("id").alias("node"), F.col("reply_to").alias("parent"), "parent_ends")
    ends = closure.chain_ends(links, ["doc_id"], max_depth)
    return ends.select("doc_id", F.col("node").alias("id"), F.col("root").alias("root_id"), F.col("hops").alias("depth"))


def threads(comments: DataFrame, roots: DataFrame, width: int = 65536) -> DataFrame:
    """Replies numbered within their thread in the order given by `ord`."""
    rows = roots.join(comments.select("doc_id", "id", "ord"), ["doc_id", "id"])
    return blocks.scan(blocks.by_value(rows, "ord", width), ["doc_id", "root_id"], ["ord"], reply_no=("number", None))


def review_states(comments: DataFrame) -> DataFrame:
    """The latest review status set on a comment by a reply; the status None clears it."""
    changes = comments.where(_is_reply() & (F.lower("state_model") == REVIEW) & F.col("state").isNotNull())
    latest = changes.groupBy("doc_id", F.col("reply_to").alias("id")).agg(F.max_by("state", F.struct("created", "ord")).alias("state"))
    return latest.where((F.col("state") != "") & (F.lower("state") != "none"))


def thread_summary(comments: DataFrame, roots: DataFrame) -> DataFrame:
    """Per thread its replies, how deep it goes and the review status of the comment it starts at."""
    counted = roots.groupBy("doc_id", F.col("root_id").alias("id")).agg(F.count(F.lit(1)).alias("replies"), F.max("depth").alias("depth"))
    return counted.join(review_states(comments), ["doc_id", "id"], "left").withColumnRenamed("id", "root_id")
