"""Rows of a group taken one after the other, with a small state carried along.

For rules where an earlier member decides about later ones, which neither windows nor joins say: rows come sorted to the task of their
group, which holds the state and one batch of them, however many rows the group has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS = {"long": (T.LongType(), pa.int64()), "double": (T.DoubleType(), pa.float64()), "string": (T.StringType(), pa.string())}


def walk(df: DataFrame, keys: Sequence[str], order: Sequence[str], reads: Sequence[str], adds: dict[str, str], begin: Callable, step: Callable) -> DataFrame:
    """`df` with the columns `adds` (name to long, double or string).

    `begin()` is the state before a group's first row; `step(state, *values of reads)` gives the next state and the row's new values.
    Rows that agree in `order` may come in either order.
    """
    keys, order = list(keys), list(order)
    names = [*df.columns, *adds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            groups = zip(*[batch[k].to_pylist() for k in keys])
            values = zip(*[batch[c].to_pylist() for c in reads])
            made = []
            for group, row in zip(groups, values):
                if group != key:
                    key, state = group, begin()
                state, new = step(state, *row)
                made.append(new)
            columns = zip(*made) if made else [()] * len(adds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, _KINDS[k][1]) for c, k in zip(columns, adds.values()))], names)

    schema = T.StructType([*df.schema.fields, *(T.StructField(name, _KINDS[kind][0]) for name, kind in adds.items())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
