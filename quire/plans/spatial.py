"""Grid cells that turn spatial conditions into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def box_cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """The cells `{cx, cy}` a box touches."""
    columns = F.sequence(cell(x0, size), cell(x1, size))
    rows = F.sequence(cell(y0, size), cell(y1, size))
    return F.flatten(F.transform(columns, lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def segment_cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float, slack: float = 0.0, height: float | None = None) -> Column:
    """The cells, `size` wide and `height` or else `size` high, within `slack` of a line segment: per column of cells, the rows it crosses there or near it."""
    height = height or size
    left, right, around = F.least(x0, x1), F.greatest(x0, x1), slack + 1e-6
    slope = F.when(x1 == x0, F.lit(0.0)).otherwise((y1 - y0) / F.when(x1 == x0, F.lit(1.0)).otherwise(x1 - x0))

    def column(cx: Column) -> Column:
        # What is within the slack of this column, taken from the segment itself.
        a, b = F.least(right, F.greatest(left, cx * size - around)), F.greatest(left, F.least(right, (cx + 1) * size + around))
        ya = F.when(x1 == x0, y0).otherwise(y0 + (a - x0) * slope)
        yb = F.when(x1 == x0, y1).otherwise(y0 + (b - x0) * slope)
        rows = F.sequence(cell(F.least(ya, yb) - around, height), cell(F.greatest(ya, yb) + around, height))
        return F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(left - around, size), cell(right + around, size)), column))
