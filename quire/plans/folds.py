"""Products taken in order, each step rounded as form calculations do."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions import exactnumbers as exact


def product(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "product") -> DataFrame:
    """`(keys, out)`: the product of the numbers written in `value`, in the given order, as text; null when it overflows.

    Rounding makes the order matter, so parts of a group cannot be multiplied apart. A group comes sorted to one task, which
    holds one number of it at a time: a group may have any number of rows.
    """
    keys = list(keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + f", {out} string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number = None, None
        for batch in batches:
            done = []
            for *own, text in zip(*[batch[k].to_pylist() for k in keys], batch[value].to_pylist()):
                if own != key:
                    if key is not None:
                        done.append((*key, exact.shown(number)))
                    key, number = own, (1, 0)
                if number is not None:
                    factor = exact.read(text)
                    number = None if factor is None else exact.multiply(number, factor)
            yield _rows(done)
        if key is not None:
            yield _rows([(*key, exact.shown(number))])

    kinds = df.select(*keys).schema

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64() if f.dataType.typeName() in ("long", "bigint") else pa.string() for f in kinds]
        columns = list(zip(*done)) or [[]] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [*types, pa.string()])], [*keys, out])

    sorted_ = df.select(*keys, *order, value).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.select(*keys, value).mapInArrow(fold, schema)
