"""Places of pattern matches inside a row, counted in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def running(values: Column) -> Column:
    """Sums of the elements before each element, and the total last. Sums of blocks of 64 are taken first, so the work is
    about 64 times the length."""
    n = F.size(values)
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda k: add(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))

    def with_blocks(sums: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda k: add(F.slice(sums, F.lit(1), k)))

        def inner(begin: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n), lambda i: F.get(begin, F.floor(i / BLOCK).cast("int")) + add(F.slice(values, i - i % BLOCK + 1, i % BLOCK)))

        return F.transform(F.array(starts), inner)[0]

    return F.transform(F.array(blocks), with_blocks)[0]


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing: an array of (start, end, match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))

    def placed(pair: Column) -> Column:
        lengths = F.zip_with(F.slice(pair["gaps"], 1, F.size(pair["found"])), pair["found"], lambda g, m: g + F.char_length(m))

        def with_sums(sums: Column) -> Column:
            at = F.transform(pair["found"], lambda m, i: (F.get(sums, i) + F.get(pair["gaps"], i)).cast("bigint"))
            return F.zip_with(at, pair["found"], lambda s, m: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("match")))

        return F.transform(F.array(running(lengths)), with_sums)[0]

    def from_found(some: Column) -> Column:
        nothing = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
        pair = F.struct(some.alias("found"), gaps.alias("gaps"))
        return F.when(F.size(some) == 0, nothing).otherwise(F.transform(F.array(pair), placed)[0])

    return F.transform(F.array(found), from_found)[0]
