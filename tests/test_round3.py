"""Findings of round 3: larger keys, odd texts and crowded pages."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.operators import compare as comparing
from quire.operators import geometry, tables
from tests.oracle import compare

SMALL = pathlib.Path("/root/testdata/sf0.001")


def given(spark, folder, **tables):
    """The smallest tables, some of them replaced."""
    for path in SMALL.iterdir():
        (folder / path.name).symlink_to(path)
    for name, df in tables.items():
        (folder / f"{name}.parquet").unlink()
        df.toPandas().to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    return str(folder)


def matches(spark, folder, name):
    problems, rows = compare(spark, folder, entry.queries()[name], entry.oracle_sql()[name])
    assert not problems
    assert rows > 0


def test_placed_cells_with_large_keys(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr("* except (o_orderkey)", "o_orderkey + 2000003 AS o_orderkey")
    matches(spark, given(spark, tmp_path, orders=orders), "E11_place_cells")


@pytest.mark.parametrize("name", ["D3_edit_counts", "D3_word_diff", "D5_change_runs"])
def test_diff_of_repeated_words(spark, tmp_path, name):
    """Words that come back in other order make anchors between places that do not belong together."""
    dice = random.Random(3)
    rows = [(i, "en", "web", " ".join(f"w{dice.randrange(2 + i % 9)}" for _ in range(60 + i))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("n_chars", F.length("text").cast("long"))
    matches(spark, given(spark, tmp_path, documents=docs), name)


def test_snapping_near_cell_edges(spark):
    """Every kind of segment against every point of its page, one by one."""
    dice = random.Random(4)
    spot = lambda: float(dice.choice([dice.randrange(-120, 300), 96 * dice.randrange(4), 96 * dice.randrange(4) - 6, dice.random() * 300]))
    segments = [(1, p, s, spot(), spot(), spot(), spot()) for p in range(12) for s in range(4)]
    segments += [(1, p, 4, x, y, x, spot()) for p in range(12) for x, y in [(spot(), spot())]] + [(1, p, 5, x, y, x, y) for p in range(12) for x, y in [(spot(), spot())]]
    points = [(1, p, i, x0 + dice.choice([-6, 0, 6, 2.5, -5]) + dice.choice([0, 0.5, 0.9]) * (x1 - x0), y0 + dice.choice([0, 3, -6]) + dice.choice([0, 0.5, 0.9]) * (y1 - y0))
              for i, (_, p, s, x0, y0, x1, y1) in enumerate(segments * 10)]
    found = {(r.page_no, r.id): (r.kind, r.x, r.y) for r in geometry.snap(
        spark.createDataFrame(points, "doc_id long, page_no long, id long, x double, y double"),
        spark.createDataFrame(segments, "doc_id long, page_no long, seg_id long, x0 double, y0 double, x1 double, y1 double"), 6.0).collect()}
    assert len(found) == len(points)
    for _, p, i, x, y in points:
        best = None
        for _, q, s, x0, y0, x1, y1 in segments:
            if q != p:
                continue
            dx, dy = x1 - x0, y1 - y0
            t = max(0.0, min(1.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy > 0 else 0.0
            for rank, tx, ty in [(0, x0, y0), (0, x1, y1), (1, (x0 + x1) / 2, (y0 + y1) / 2), (2, x0 + t * dx, y0 + t * dy)]:
                d = (tx - x) * (tx - x) + (ty - y) * (ty - y)
                if d <= 36 and (best is None or (rank, d, s, tx, ty) < best):
                    best = (rank, d, s, tx, ty)
        assert found[p, i] == (("None", x, y) if best is None else (("Endpoint", "Midpoint", "OnPath")[best[0]], *best[3:]))


def test_sheets_work_cells_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(number):
        seen.add(1)
        return str(number)

    cells = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("table_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), text("id").alias("text"), F.lit("Page 1").alias("sheet"))
    tables.write_sheets(cells, f"{tmp_path}/sheets")
    assert seen.value == 1000 and tables.read_sheets(spark, f"{tmp_path}/sheets", cells.schema).count() == 1000
