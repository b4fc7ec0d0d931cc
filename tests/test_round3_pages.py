"""F16, F24: a page's boxes are one row while its gutters are found, so a task holds few sorted copies of them."""

import pytest

from quire.operators import layout
from tests.test_round3_growth import plan


@pytest.mark.parametrize("name, sorts", [("E8_gutters", 6), ("E9_reading_order", 8)])
def test_few_copies_of_boxes(spark, name, sorts):
    text = plan(spark, name)
    assert text.count("Sort [") <= sorts
    assert text.count("Join") == (1 if name == "E8_gutters" else 2)


def test_two_gutters_of_three_columns(spark):
    """Equal boxes count each, boxes without size do not; a strip with a fifth of the text to its sides is first, the next splits the wider part."""
    column = lambda d, x, n: [(d, 1, x, 14.0 * i, 100.0, 12.0) for i in range(n)]
    rows = [*column(1, 50.0, 6), *column(1, 200.0, 6), *column(1, 350.0, 6), (1, 1, 160.0, 0.0, 0.0, 12.0), (1, 1, 160.0, 0.0, 20.0, 0.0), *column(2, 50.0, 2) * 3, *column(2, 200.0, 2) * 3,
            *column(3, 50.0, 6), *column(3, 200.0, 1), *column(4, 50.0, 2), *column(4, 200.0, 2)]
    boxes = spark.createDataFrame(rows, "doc_id long, page_no int, x double, y double, w double, h double")
    found = sorted((r.doc_id, r.g_from, r.g_to) for r in layout.gutters(boxes).collect())
    assert found == [(1, 150.0, 200.0), (1, 300.0, 350.0), (2, 150.0, 200.0)]
