"""Longest chains of points in which both coordinates grow.

A point that is in order with every other point of its key is in every longest chain; two running extremes show which ones are.
They cut the rest into stretches, and only stretches of points out of order with one another are searched, as numbers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans import blocks
from quire.plans.checkpoints import cut, stored


def increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence: piles by their least last value, each value pointing back."""
    tops, at_top, back = [], [], [-1] * len(values)
    for k, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            at_top.append(k)
        else:
            tops[pile], at_top[pile] = value, k
        back[k] = at_top[pile - 1] if pile else -1
    out = []
    k = at_top[-1] if at_top else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def longest(points: DataFrame, keys: Sequence[str], width: int = 65536) -> DataFrame:
    """`points` `(keys, i, j)`, where neither an i nor a j stands twice under a key, cut down to a longest chain per key.

    Stretches between points that are in order with all others are groups of their own; a stretch is moved text, and
    its points are held as numbers in one task.
    """
    keys = list(keys)
    seen = blocks.scan(blocks.by_value(points, "i", width), keys, ["i"], _most=("max_before", "j"), _least=("min_after", "j"))
    fixed = F.coalesce(F.col("_most") < F.col("j"), F.lit(True)) & F.coalesce(F.col("_least") > F.col("j"), F.lit(True))
    seen = stored(seen.select(*keys, "i", "j", fixed.alias("_fixed")), "chains")
    moved = cut(seen.where(~F.col("_fixed")).select(*keys).distinct())
    loose = blocks.scan(blocks.by_value(seen.join(moved, keys, "left_semi").withColumn("_one", F.col("_fixed").cast("long")), "i", width), keys, ["i"], _stretch=("sum", "_one"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        return rows.iloc[np.array(increasing(rows["j"].tolist()), np.int64)][[*keys, "i", "j"]]

    schema = points.select(*keys, "i", "j").schema
    found = loose.where(~F.col("_fixed")).select(*keys, "_stretch", "i", "j").groupBy(*keys, "_stretch").applyInPandas(search, schema)
    return seen.where("_fixed").select(*keys, "i", "j").unionByName(found)
