"""Findings of round 4: what is moved and written, and the same results."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.catalog import marks, tabular
from quire.functions import arrays, myers
from quire.operators import compare, geometry, tables
from tests.test_round3 import SMALL
from tests.test_text import lcs, whole


def moved(spark, run):
    """Bytes that `run` shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = lambda: sum(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(k).totalShuffleWrite() for k in range(1))
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


@pytest.mark.parametrize("name", ["D3_word_diff", "D3_edit_counts", "D5_change_runs"])
def test_diffs_move_tokens_packed(spark, name):
    """Two versions of about 100,000 words: some bytes a word, not a row a word and step."""
    done = moved(spark, lambda: entry.queries()[name](spark, str(SMALL)).write.format("noop").mode("overwrite").save())
    assert done < 8e6


def test_diff_of_odd_tokens(spark):
    """Empty tokens and the marks of packed arrays are tokens like others; lists end inside and at the end of a block."""
    dice = random.Random(7)
    kinds = ["", arrays.BETWEEN, arrays.MARK, arrays.MARK + "0", arrays.MARK + "1", "1", "a", "b c", "é"]
    pairs = []
    for n in (0, 1, 2, 3, 7, 8, 9, 16, 40, 90):
        a = [dice.choice(kinds) + dice.choice(["", "x", str(dice.randrange(50))]) for _ in range(n)]
        pairs += [(a, [t for t in a if dice.random() < 0.8]), (a, []), ([], a), (a, a[::-1]), (a, ["new", *a, ""])]
    side = lambda k: spark.createDataFrame([(i, p[k]) for i, p in enumerate(pairs)], "pair_id long, tokens array<string>")
    rows = lambda k: side(k).select("pair_id", F.posexplode("tokens").alias("pos", "folded")).withColumn("token", F.col("folded"))
    by_lists = compare.script(compare.diff_runs(compare.list_blocks(side(0), 8), compare.list_blocks(side(1), 8), 8))
    by_rows = compare.diff_words(rows(0), rows(1), width=8)
    for df in (by_lists, by_rows):
        found = {}
        for r in df.collect():
            found.setdefault(r.pair_id, []).append((r.op, r.i, r.j))
        for i, (a, b) in enumerate(pairs):
            assert whole(sorted(found.get(i, []), key=lambda s: (s[1] + s[2], s[0] != "-")), a, b) == lcs(a, b)
    changed = compare.change_runs(by_rows, rows(0), rows(1), width=8).where("pair_id % 5 = 1").collect()
    assert {r.pair_id: r.old_text for r in changed} == {i: " ".join(a) for i, (a, _) in enumerate(pairs) if i % 5 == 1 and a}


def test_scripts_of_many_and_of_few_edits(monkeypatch):
    dice = random.Random(8)
    for few in (0, 3, 512):
        monkeypatch.setattr(myers, "FEW", few)
        for letters in (2, 5, 60):
            for size in (5, 30, 120):
                a = [dice.randrange(letters) for _ in range(size)]
                b = [dice.randrange(letters) if dice.random() < 0.2 else x for x in a if dice.random() < 0.9]
                assert whole(myers.gap_script(a, b), a, b) == lcs(a, b)


@pytest.mark.parametrize("sheets", [True, False])
def test_cells_are_dealt_out_once(spark, sheets):
    """Items are moved before their cells are rows; typing by column, and the files of sheets, need no other move."""
    text = tabular._typed(spark, str(SMALL), sheets)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert text.count("Exchange") == 1 and "Join" not in text


def test_dealt_sheets_are_ordered_in_files(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 50).alias("doc_id"), (F.col("id") % 2 + 1).alias("table_id"), F.floor(F.col("id") / 100).alias("row"), F.concat(F.lit("S"), F.col("id") % 2).alias("sheet"))
    cells = tables.deal_to_sheets(rows.repartition(7)).select("*", F.explode(F.array(F.lit(1), F.lit(0))).alias("col"))
    tables.write_sheets(cells, f"{tmp_path}/sheets", dealt=True)
    files, seen = {}, 0
    for r in spark.read.parquet(f"{tmp_path}/sheets").select("*", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect():
        files.setdefault(r.file_path, []).append((r.doc_id, r.table_id, r.row, r.col))
        seen += 1
    assert seen == 1200 and all(f == sorted(f) for f in files.values())
    assert sum(len({x[:2] for x in f}) for f in files.values()) == 50  # a table is in one file
    assert len(files) <= 2 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_columns_that_say_both_say_nothing(spark):
    """Day first, month first, both, neither; a missing text and texts that are no dates say nothing."""
    columns = {0: ["13/02/2020", "01/02/2020", None], 1: ["02/13/2020", "01/02/2020", "x"], 2: ["13/02/2020", "02/13/2020", "01/02/2020"], 3: ["01/02/2020", "", None], 4: [None], 5: ["2020-02-01", "01/02/2020"]}
    cells = spark.createDataFrame([(1, t, r, c, x) for t in (1, 2) for c, v in columns.items() for r, x in enumerate(v)], "doc_id long, table_id int, row int, col int, text string")
    found = {(r.col, r.row): (r.kind, str(r.date)) for r in tables.type_columns(cells).where("table_id = 2").collect()}
    assert [found[c, r] for c, r in ((0, 1), (1, 1), (2, 2), (3, 0), (5, 1))] == [("Date", "2020-02-01"), ("Date", "2020-01-02"), ("Text", "None"), ("Text", "None"), ("Text", "None")]
    assert [found[c, r][0] for c, r in ((0, 0), (0, 2), (1, 2), (2, 0), (2, 1), (5, 0))] == ["Date", "Text", "Text", "Date", "Date", "Date"]


def test_points_are_not_sorted(spark):
    """Points meet the lists of their cells by hash; nothing is sorted."""
    text = entry.queries()["G4_snap"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_snapping_to_crowded_and_steep_segments(spark):
    """Points near many segments, none, equal ones and steep ones, at the edges of cells 192 wide and 24 high, against every segment of the page."""
    dice = random.Random(12)
    spot = lambda w: float(dice.choice([w * dice.randrange(-2, 5), w * dice.randrange(4) + dice.choice([-6, 6, 0.5]), dice.random() * 4 * w]))
    segments = [(1, p, s, spot(192), spot(24), spot(192), spot(24) * dice.choice([1, 8])) for p in range(8) for s in range(12)]
    segments += [(1, p, 20 + s, *segments[p * 12][3:]) for p in range(8) for s in range(3)]  # equal ones, with higher numbers
    points = [(1, p, i, x0 + t * (x1 - x0) + dice.choice([-6, 0, 6, 1.5, 40]), y0 + t * (y1 - y0) + dice.choice([0, 5.9, -6, 30]))
              for i, (_, p, s, x0, y0, x1, y1) in enumerate(segments * 6) for t in [dice.choice([0, 0.5, 1, 0.3])]]
    found = {(r.page_no, r.id): (r.kind, r.x, r.y) for r in geometry.snap(
        spark.createDataFrame(points, "doc_id long, page_no long, id long, x double, y double"),
        spark.createDataFrame(segments, "doc_id long, page_no long, seg_id long, x0 double, y0 double, x1 double, y1 double"), 6.0).collect()}
    assert len(found) == len(points) and {v[0] for v in found.values()} == {"Endpoint", "Midpoint", "OnPath", "None"}
    for _, p, i, x, y in points:
        offers = []
        for _, q, s, x0, y0, x1, y1 in segments:
            dx, dy = x1 - x0, y1 - y0
            t = max(0.0, min(1.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy > 0 else 0.0
            offers += [(rank, (tx - x) * (tx - x) + (ty - y) * (ty - y), s, tx, ty) for rank, tx, ty in [(0, x0, y0), (0, x1, y1), (1, (x0 + x1) / 2, (y0 + y1) / 2), (2, x0 + t * dx, y0 + t * dy)] if q == p]
        best = min((o for o in offers if o[1] <= 36), default=None)
        assert found[p, i] == (("None", x, y) if best is None else (("Endpoint", "Midpoint", "OnPath")[best[0]], *best[3:]))


def test_thousandths_as_rounded(spark):
    dice = random.Random(14)
    values = [dice.choice([-1, 1]) * v for _ in range(1500) for v in (dice.random() * 10 ** dice.randrange(-4, 14), dice.randrange(10**6) / 2000, math.nextafter(dice.randrange(10**5) / 2000, dice.choice([0, 1e9])))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(marks._thousandths(F.col("v")).alias("a"), (F.round("v", 3).cast("decimal(28,3)") * 1000).cast("long").alias("b"))
    assert rows.where("a <> b").count() == 0
