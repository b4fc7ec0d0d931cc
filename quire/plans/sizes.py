"""Broadcast only what is known to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 10_000


def rules(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of rules written by the caller: it lives on the driver already, so its size is known."""
    if len(rows) > MAX_RULES:
        raise ValueError(f"{len(rows)} rules; pass large rule sets as a table")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Mark a table for broadcast when a count shows it has at most `rows` rows; else leave it to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
