"""what lists and repeated lines move between tasks."""

import random

import pytest

import __spark_entry__ as entry
from quire.operators import layout
from tests.test_round3 import SMALL


def moved(spark, name):
    """The columns of every exchange of a query."""
    found = []

    def visit(node):
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    plan = entry.queries()[name](spark, str(SMALL))._jdf.queryExecution().executedPlan()
    visit(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return found


@pytest.mark.parametrize("name", ["E5_list_groups", "E5_list_levels", "E6_strip_repeated"])
def test_texts_stay_where_they_are(spark, name):
    columns = moved(spark, name)
    assert columns and not any({"text", "key"} & c for c in columns)


def test_lists_with_and_without_other_columns(spark):
    dice = random.Random(2)
    marks = ["1. ", "2. ", "3. ", "(a) ", "(b) ", "• ", "- ", "", "", "  "]
    rows = [(d, n, dice.choice(marks) + dice.choice(["x", "", "some words"]), dice.choice([72.0, 80.0, 90.0]), 60.0, n * 7) for d in range(5) for n in range(60)]
    lines = spark.createDataFrame(rows, "doc_id long, ord long, text string, x double, w double, other int")
    names = ["doc_id", "ord", "format", "style", "value", "level", "list_start", "items"]
    full, few = layout.list_groups(lines), layout.list_groups(lines, keep=["other"])
    assert full.columns == [*lines.columns, *names[2:]] and few.columns == ["doc_id", "ord", "other", *names[2:]]
    assert sorted(map(tuple, full.select(*names, "other").collect())) == sorted(map(tuple, few.select(*names, "other").collect()))
    assert full.count() > 50


def test_repeated_lines_with_and_without_texts(spark):
    rows = [(d, p, o, text, 12.0 + 700 * (o == 9), 12.0) for d in range(3) for p in range(12) for o, text in ((0, f"Page {p}"), (1, "IV"), (9, f"Foot {d}"), (9, "")) if (p + o) % 5]
    lines = spark.createDataFrame(rows, "doc_id long, page_no long, ord int, text string, y double, h double")
    full, few = layout.repeated_lines(lines), layout.repeated_lines(lines, texts=False)
    place = ["doc_id", "zone", "page_no", "ord", "y", "page_count", "on_pages"]
    assert full.columns == ["doc_id", "zone", "page_no", "ord", "key", "text", "y", "page_count", "on_pages"] and few.columns == place
    assert sorted(map(tuple, full.select(*place).collect())) == sorted(map(tuple, few.collect()))
    assert {(r.key, r.text) for r in full.where("page_no = 2").collect()} == {("page #", "Page 2"), ("#upperRoman", "IV"), *[("foot #", f"Foot {d}") for d in range(3)]}
