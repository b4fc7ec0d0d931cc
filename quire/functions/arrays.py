"""Array expressions that stay inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 64


def exclusive_prefix(values: Column) -> Column:
    """[0, v1, v1+v2, …] for an array<int>, one entry per value.

    Every entry is the one before it and a value. Strides are taken one after the other, so a long array costs n·STEP/2 copies
    inside them and n²/(2·STEP) between them. Materialise `values` as a column first: it is used several times.
    """
    running = lambda part, base: F.aggregate(part, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    strides = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"))
    stride = lambda acc, s: F.concat(acc, F.slice(running(F.slice(values, s * STEP + 1, STEP), F.element_at(acc, -1)), 2, STEP))
    sums = F.when(F.size(values) <= STEP, running(values, F.lit(0))).otherwise(F.aggregate(strides, F.array(F.lit(0)), stride))
    return F.when(F.size(values) > 0, F.slice(sums, 1, F.size(values))).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


# Between the texts of a packed array; marks inside a text are written as MARK and a digit.
BETWEEN, MARK = "\u001f", "\u001e"


def packed(texts: Column) -> Column:
    """An array of texts as one text, a third as large to move. No other array but one with nulls in the same places is packed the same."""
    plain = F.array_join(texts, "")
    marked = F.transform(texts, lambda t: F.replace(F.replace(t, F.lit(MARK), F.lit(MARK + "0")), F.lit(BETWEEN), F.lit(MARK + "1")))
    odd = F.contains(plain, F.lit(MARK)) | F.contains(plain, F.lit(BETWEEN))
    return F.array_join(F.when(odd, marked).otherwise(texts), BETWEEN, MARK + "2")


def unpacked(text: Column) -> Column:
    """The texts of a packed array of at least one, marks as they are: equal ones are equal, to be shown they go through `shown`."""
    return F.split(text, BETWEEN, -1)


def shown(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit(MARK + "2"), F.lit("")), F.lit(MARK + "1"), F.lit(BETWEEN)), F.lit(MARK + "0"), F.lit(MARK))
