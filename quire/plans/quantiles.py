"""Exact order statistics without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import blocks


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per key `n` and the value at each 1-based rank, a function of n.

    Equal values are counted first, then ranked by range-partitioned running counts.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = blocks.scan(blocks.by_range(counted, keys, [value]), keys, [value], _upto=("sum", "_n"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return (
        ranked.join(sizes, keys).groupBy(*keys)
        .agg(F.first("n").alias("n"),
             *[F.min(F.when(F.col("_upto") >= rank(n), F.col(value))).alias(name) for name, rank in ranks.items()])
    )
