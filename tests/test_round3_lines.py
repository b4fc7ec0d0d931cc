"""Findings of round 3 that are projections: lines, tokens and marks, read and moved once."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import geometry, layout, units
from tests.test_round3_growth import plan


def test_tokens_are_numbered_before_they_are_rows(spark):
    """T5: two reads of lines, one of tokens; nothing is moved or sorted once tokens are rows of their own."""
    text = plan(spark, "T5_compare_tokens")
    assert text.count("Generate ") <= 3
    assert "Exchange" not in text[: text.index("Generate ")] and "Sort" not in text[: text.index("Generate ")]


def test_marks_reach_lines_before_words(spark):
    """G6: lines are read once, and no word is moved."""
    text = plan(spark, "G6_redact_areas")
    assert text.count("FileScan") == 2 and "Exchange" not in text[: text.index("Generate ")]


def test_words_of_lines_read_once(spark):
    """E1: words are read once and meet no copy of themselves."""
    text = plan(spark, "E1_assemble_lines")
    assert text.count("FileScan") == 1 and "Join" not in text


def test_line_tokens_as_word_by_word(spark):
    dice = random.Random(3)
    pieces = ["don't", " ", "  ", "\t", " ", " ", "3.14", "…", "“a”", "é́", "\U0001f600x", "-", "\u0085", "​", "\x1f"]
    rows = [(d, p, n, "".join(dice.choice(pieces) for _ in range(dice.choice([0, 1, 5, 300]))), 72.0) for d in range(4) for p in (1, 2, 64, 130) for n in range(3)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, text string, x double")
    words = units.words(lines).withColumns({"w": 6.0 * F.col("length"), "x": F.col("x") + 6 * F.col("start")})
    names = ["doc_id", "page_no", "line_no", "start", "length", "token", "folded", F.round("x", 4).alias("x"), F.round("w", 4).alias("w"), "pos"]
    wanted = sorted(map(tuple, units.number_tokens(units.compare_tokens(words)).select(*names).collect()))
    found = sorted(map(tuple, units.line_tokens(lines, 6.0).select(*names).collect()))
    assert found == wanted and len(found) > 1000


def test_marks_against_all_pairs(spark):
    dice = random.Random(4)
    point = lambda n: float(dice.randrange(n))
    words = [(dice.randrange(3), dice.randrange(2), i, 0, f"w{i}", point(300), point(300), point(40), dice.choice([0.0, 12.0])) for i in range(600)]
    areas = [(dice.randrange(3), 0, point(300), point(300), point(90), point(60)) for _ in range(40)] * 2
    w = spark.createDataFrame(words, "doc_id long, page_no int, line_no int, start int, word string, x double, y double, w double, h double")
    a = spark.createDataFrame(areas, "doc_id long, page_no int, x double, y double, w double, h double")
    side = lambda p, m, q, n: max(0.0, min(p + m, q + n) - max(p, q))

    def hit(r):
        d, p, _, _, _, x, y, ww, h = r
        return any(d == m[0] and p == m[1] and ((m[2] <= x + ww / 2 <= m[2] + m[4] and m[3] <= y + h / 2 <= m[3] + m[5]) or (ww * h > 0 and side(x, ww, m[2], m[4]) * side(y, h, m[3], m[5]) / (ww * h) >= 0.25)) for m in areas)

    found = sorted(tuple(r) for r in geometry.redact_areas(w, a).select(*w.columns).collect())
    assert found == sorted(r for r in words if not hit(r)) and 0 < len(found) < 600


@pytest.mark.parametrize("tolerance", [0.0, 1.5, 4.0])
def test_lines_against_a_walk(spark, tolerance):
    dice = random.Random(6)
    words = [(d, p, float(dice.randrange(200)), dice.randrange(300) / 4, 10.0, 12.0, f"w{i}") for d in range(3) for p in range(2) for i in range(150)]
    df = spark.createDataFrame(words, "doc_id long, page_no int, x double, y double, w double, h double, word string")
    wanted = {}
    for key in {r[:2] for r in words}:
        base = None
        for r in sorted((r for r in words if r[:2] == key), key=lambda r: r[3] + r[5]):
            if base is None or r[3] + r[5] - base > tolerance:
                base = r[3] + r[5]
            wanted.setdefault((*key, base), []).append(r)
    found = {(r.doc_id, r.page_no, r.base): (r.x, r.y, r.w, r.h, r.words, r.text) for r in layout.assemble_lines(df, tolerance).collect()}
    assert found == {k: (min(r[2] for r in v), min(r[3] for r in v), max(r[2] + r[4] for r in v) - min(r[2] for r in v), max(r[3] + r[5] for r in v) - min(r[3] for r in v), len(v),
                         " ".join(r[6] for r in sorted(v, key=lambda r: (r[2], r[6])))) for k, v in wanted.items()}
