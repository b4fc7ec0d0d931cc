"""Layout on hand-made pages, gutters against a strip-by-strip count, and the shape of plans."""

import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.operators import layout, tables
from quire.plans import walks


def boxes(spark, rows):
    return spark.createDataFrame([(1, 1, i, float(x), float(y), float(w), float(h)) for i, (x, y, w, h) in enumerate(rows)], "doc_id long, page_no int, id int, x double, y double, w double, h double")


def strip_gutters(rows, min_width):
    """The rule worked out strip by strip."""
    left, right = min(r[0] for r in rows), max(r[0] + r[2] for r in rows)
    width, total = right - left, sum(r[3] for r in rows)
    if len(rows) < 6 or not 150 <= width <= 5000:
        return []
    n = math.ceil(width) + 1
    cover = [sum(h for x, _, w, h in rows if math.floor(x - left) <= k < math.ceil(x + w - left)) for k in range(n)]
    full = sorted(cover)[int(0.9 * (n - 1))]
    low = [c <= 0.2 * full for c in cover]
    runs, k = [], 0
    while k < n:
        if not low[k]:
            k += 1
            continue
        a = k
        while k < n and low[k]:
            k += 1
        if k - a >= min_width and 0.15 * width < (a + k) / 2 < 0.85 * width:
            least = min(cover[a:k])
            empty = [i for i in range(a, k) if cover[i] <= least + 0.02 * full]
            runs.append((max(cover[a:k]), a - k, a, left + empty[0], left + empty[-1] + 1))
    chosen = []
    for _, _, _, f, t in sorted(runs):
        if t - f < min(6, min_width) or any(abs((f + t) / 2 - (p + q) / 2) < 0.2 * width for p, q in chosen):
            continue
        trial = sorted([*chosen, (f, t)])
        edges = [-math.inf, *[e for g in trial for e in g], math.inf]
        mass = [sum(h for x, _, w, h in rows if x >= edges[2 * c] - 1 and x + w <= edges[2 * c + 1] + 1) for c in range(len(trial) + 1)]
        if min(mass) >= (0.2 if len(trial) == 1 else 0.15) * total:
            chosen = trial
        if len(chosen) == 2:
            break
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_gutters(spark, seed):
    dice = random.Random(seed)
    columns = [[(72, 180), (300, 210)], [(40, 150), (215, 150), (390, 150)], [(72, 400)], [(72, 230), (310, 200)]][seed]
    rows = [(x, 14 * k, w - dice.randrange(40), 10 + dice.randrange(3)) for k in range(24) for x, w in columns]
    rows.append((72, 500, 430, 12))
    found = layout.gutters(boxes(spark, rows)).orderBy("g_from").collect()
    assert [(r.g_from, r.g_to) for r in found] == strip_gutters(rows, 4)


def test_reading_order(spark):
    rows = [(x, 14 * k, 150, 12) for k in range(12) for x in (330, 72)]
    placed = layout.reading_order(boxes(spark, rows), layout.gutters(boxes(spark, rows))).orderBy("reading_no").collect()
    assert [r.x for r in placed] == [72.0] * 12 + [330.0] * 12
    assert [r.y for r in placed[:12]] == sorted(r.y for r in placed[:12])


def items(spark, texts, xs=None):
    rows = [(1, i, t, float((xs or [72] * len(texts))[i]), 6.0 * len(t)) for i, t in enumerate(texts)]
    df = layout.list_groups(spark.createDataFrame(rows, "doc_id long, ord long, text string, x double, w double"))
    return [(r.ord, r.format, r.value, r.level, r.list_start) for r in df.orderBy("ord").collect()]


def test_lists(spark):
    assert items(spark, ["1. a", "2. b", "4. c", "5. d"]) == [(0, "decimal", 1, 0, 0), (1, "decimal", 2, 0, 0), (2, "decimal", 4, 0, 2), (3, "decimal", 5, 0, 2)]
    assert items(spark, ["i. a", "ii. b", "iii. c"]) == [(0, "lowerRoman", 1, 0, 0), (1, "lowerRoman", 2, 0, 0), (2, "lowerRoman", 3, 0, 0)]
    assert items(spark, ["iv. a", "v. b", "vi. c"]) == [(0, "lowerRoman", 4, 0, 0), (1, "lowerRoman", 5, 0, 0), (2, "lowerRoman", 6, 0, 0)]
    assert items(spark, ["h. a", "i. b", "j. c"]) == [(0, "lowerLetter", 8, 0, 0), (1, "lowerLetter", 9, 0, 0), (2, "lowerLetter", 10, 0, 0)]
    assert items(spark, ["- alone", "Plain text", "• real"]) == [(2, "bullet", 0, 0, 2)]
    nested = items(spark, ["1. a", "a) b", "b) c", "2. d", "a) e", "b) f"], [72, 96, 96, 72, 96, 96])
    assert [(v, level, start) for _, _, v, level, start in nested] == [(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 0, 0), (1, 1, 0), (2, 1, 0)]


def test_levels_by_their_first_marker(spark):
    """A chain of near markers is no level: 72 takes 76 and 66, but 80 and 86 are on the next one."""
    found = items(spark, ["1. a", "2. b", "1) c", "2) d", "3. e", "(1) f", "4. g"], [72, 76, 80, 86, 66, 92, 74])
    assert [(v, level) for _, _, v, level, _ in found] == [(1, 0), (2, 0), (1, 1), (2, 1), (3, 0), (1, 2), (4, 0)]


def test_rows_by_their_first_box(spark):
    """Baselines 0, 3, 6, 9 at size 11: the third is over 3.3 points from the first, so rows are 0, 3 and 6, 9."""
    rows = [(72.0 + 150 * c, 30.0 * r + 3 * c, f"r{r}c{c}") for r in range(4) for c in range(2)] + [(72.0 + 150 * c, 30.0 * r + 3 * c, f"r{r}c{c}") for r in range(4) for c in (2, 3)]
    df = spark.createDataFrame([(1, 1, x, y, 60.0, 12.0, 11.0, t) for x, y, t in rows], "doc_id long, page_no int, x double, y double, w double, h double, size double, text string")
    found = {r.text: (r.row, r.col) for r in tables.grid_tables(df).collect()}
    assert found == {f"r{r}c{c}": (2 * r + c // 2, c) for r in range(4) for c in range(4)}
    walked = walks.walk(df.withColumn("_base", F.col("y") + F.col("h")), ["doc_id", "page_no"], ["_base", "x"], ["_base", "size"], {"row": "long"}, lambda: (None, 0.0, 0), tables._same_row)
    assert [r.row for r in walked.where("y < 30").orderBy("y").collect()] == [1, 1, 2, 2]


def test_walks_carry_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.lit(None).cast("string").alias("other"))
        sums = walks.walk(df, ["k"], ["id"], ["id"], {"total": "long"}, lambda: 0, lambda s, v: (s + v, (s + v,)))
        assert all(r.total == sum(range(r.k, r.id + 1, 3)) for r in sums.collect()) and sums.count() == 100
        assert walks.walk(df.where("false"), ["k"], ["id"], ["id"], {"total": "long"}, lambda: 0, lambda s, v: (s + v, (s + v,))).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_aligned_table(spark):
    rows = [(72 + 150 * c, 20 * r, 60, 12, 11.0, f"r{r}c{c}") for r in range(4) for c in range(3)] + [(72, 300, 460, 12, 11.0, "A line of plain text under the table")]
    df = spark.createDataFrame([(1, 1, float(x), float(y), float(w), float(h), s, t) for x, y, w, h, s, t in rows], "doc_id long, page_no int, x double, y double, w double, h double, size double, text string")
    found = {(r.row, r.col): r.text for r in tables.grid_tables(df).collect()}
    assert found == {(r, c): f"r{r}c{c}" for r in range(4) for c in range(3)}


def test_cell_placement(spark):
    rows = [(1, 1, 0, 0, 2, 1), (1, 1, 0, 1, 1, 2), (1, 1, 1, 2, 1, 1), (1, 1, 1, 3, 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, table_id long, row int, ord int, row_span int, col_span int")
    assert [r.col for r in tables.place_cells(df).orderBy("ord").collect()] == [0, 1, 1, 2]


FOLDER = "/root/testdata/sf0.001"
PYTHON = {"C5_find_many", "D3_word_diff", "D3_edit_counts", "D5_change_runs", "F3_calculate", "F3_by_style", "F3_product", "F7_derive", "E5_list_groups", "E5_list_levels", "E10_grid_tables"}
# Streams run when they are built; the plan of what they wrote says nothing.
LIGHT = [n for n in entry.queries() if not n.startswith("N")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_plan(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "Python" not in text and "Pandas" not in text


def test_no_local_checkpoints():
    root = pathlib.Path(__file__).parent.parent / "quire"
    assert not [p for p in root.rglob("*.py") if "localCheckpoint" in p.read_text() or "crossJoin" in p.read_text()]


def test_columns_reach_the_scan(spark):
    text = plan(entry.queries()["Q2_worst_pages"](spark, FOLDER))
    assert "TakeOrderedAndProject" in text and "props" not in text
