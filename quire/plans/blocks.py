"""Windows over groups of any size.

A group (a document, a source, the whole corpus) is cut into ordered blocks. Windows run inside a
block, and one row per block carries sums, maxima and edge rows from block to block, so no task ever
holds a whole group. Blocks come from an integer position (`by_value`) or, where the order has no
dense position, from range partitions of a checkpointed table (`by_range`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.checkpoints import cut

BLOCK = "_block"


def by_value(df: DataFrame, position: str | Column, width: int) -> DataFrame:
    """Blocks of `width` consecutive positions."""
    column = F.col(position) if isinstance(position, str) else position
    return df.withColumn(BLOCK, F.floor(column / F.lit(width)))


def by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Blocks of about equal size by sorted order, fixed by writing the range partitions out."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *keys, *order))
    return ranged.withColumn(BLOCK, F.spark_partition_id().cast("long"))


def _whole(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], **outs: tuple[str, str | None]) -> DataFrame:
    """Ordered columns over `keys`, computed block by block.

    Each output is (kind, column): `number` (1, 2, …), `sum` (running, this row included), `max_before`
    (over earlier rows), `min_after` (over later rows), `prev` and `next` (the neighbouring row's value). `order` is ascending and total.
    """
    keys, order = list(keys), list(order)
    local = W.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    before = local.rowsBetween(W.unboundedPreceding, -1)
    after = local.rowsBetween(1, W.unboundedFollowing)
    at = F.struct(*order)
    across = _whole(keys).orderBy(BLOCK)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    later = across.rowsBetween(1, W.unboundedFollowing)

    inside, totals, carried, result = {}, [], [], {}
    inside["_first"] = F.row_number().over(local) == 1
    for name, (kind, column) in outs.items():
        tmp, block, carry = f"_in_{name}", f"_tot_{name}", f"_carry_{name}"
        if kind == "number":
            inside[tmp] = F.row_number().over(local).cast("long")
            totals.append(F.count(F.lit(1)).alias(block))
            carried.append(F.sum(block).over(earlier).alias(carry))
            result[name] = F.col(tmp) + F.coalesce(carry, F.lit(0))
        elif kind == "sum":
            inside[tmp] = F.sum(column).over(upto)
            totals.append(F.sum(column).alias(block))
            carried.append(F.sum(block).over(earlier).alias(carry))
            result[name] = F.coalesce(F.col(tmp) + F.col(carry), tmp, carry)
        elif kind == "max_before":
            inside[tmp] = F.max(column).over(before)
            totals.append(F.max(column).alias(block))
            carried.append(F.max(block).over(earlier).alias(carry))
            result[name] = F.greatest(tmp, carry)
        elif kind == "min_after":
            inside[tmp] = F.min(column).over(after)
            totals.append(F.min(column).alias(block))
            carried.append(F.min(block).over(later).alias(carry))
            result[name] = F.least(tmp, carry)
        elif kind == "prev":
            inside[tmp] = F.lag(column).over(local)
            totals.append(F.max_by(column, at).alias(block))
            carried.append(F.lag(block).over(across).alias(carry))
            result[name] = F.when(F.col("_first"), F.col(carry)).otherwise(F.col(tmp))
        elif kind == "next":
            inside["_last"] = F.lead(F.lit(1)).over(local).isNull()
            inside[tmp] = F.lead(column).over(local)
            totals.append(F.min_by(column, at).alias(block))
            carried.append(F.lead(block).over(across).alias(carry))
            result[name] = F.when(F.col("_last"), F.col(carry)).otherwise(F.col(tmp))
        else:
            raise ValueError(kind)

    # Groups inside one block (nearly all of them) carry nothing, so the carry table is tiny.
    edges = (
        df.groupBy(*keys, BLOCK).agg(*totals)
        .select(*keys, BLOCK, *carried, F.count(F.lit(1)).over(_whole(keys)).alias("_blocks"))
        .where("_blocks > 1").drop("_blocks")
    )
    # Null keys are groups too, so the carry is joined null-safe.
    renamed = edges.select(*[F.col(c).alias(f"_edge_{c}") for c in (*keys, BLOCK)], *[c for c in edges.columns if c not in (*keys, BLOCK)])
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_edge_{c}")) for c in (*keys, BLOCK)))
    joined = df.withColumns(inside).join(renamed, same, "left")
    return joined.withColumns(result).select(*[c for c in df.columns if c != BLOCK], *outs)
