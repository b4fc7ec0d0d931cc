"""Findings of round 3 that are projections: plans that grow with the input, and results on odd rows as before."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.functions import arrays
from quire.functions import exactnumbers as exact
from quire.operators import accessibility
from quire.operators import compare as comparing
from quire.operators import forms
from quire.operators.forms import Calculation
from tests.test_round3 import SMALL


def plan(spark, name):
    df = entry.queries()[name](spark, str(SMALL))
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("name", ["F3_calculate", "F4_recalculate", "F7_derive"])
def test_form_totals_without_sorts_of_all_fields(spark, name):
    """Fields are added up by hash before they are moved, and a document's calculations need no join of documents and totals."""
    text = plan(spark, name)
    assert "SortAggregate" not in text and "RDDScan" not in text
    assert text.count("Join") == (1 if name == "F4_recalculate" else 0)


def test_totals_of_numbers_of_any_length(spark):
    """Short, long, missing and unreadable numbers, alone and mixed, against whole-number sums."""
    dice = random.Random(9)
    digits = lambda n: str(dice.randrange(10 ** (n - 1), 10**n))
    kinds = [lambda: digits(3), lambda: "-" + digits(2) + ".5", lambda: digits(20), lambda: "0." + digits(19), lambda: "-" + digits(15) + "." + digits(9), lambda: "1e3", lambda: ""]
    rows = [(d, f"n.f{i}", dice.choice(kinds[: 2 + d % 6])()) for d in range(60) for i in range(1 + d % 5)] + [(99, "other", "1")]
    fields = spark.createDataFrame(rows, "doc_id long, name string, value string")
    ops = ["SUM", "AVG", "MIN", "MAX"]
    found = {(r.doc_id, r.name): r.text for r in forms.calculate(fields, [Calculation(op, op, ("n",)) for op in ops] + [Calculation("twice", "SUM", ("n", "n.f0"))]).collect()}
    assert len(found) == 61 * 5
    for d in range(60):
        own = [Decimal(v or "0") for k, _, v in rows if k == d]
        whole = [int(v.scaleb(28)) if v == v.to_integral_value() else int(str(v).replace(".", "").replace("-", "")) * 10 ** (28 + v.as_tuple().exponent) * (-1 if v < 0 else 1) for v in own]
        number = lambda n: exact.shown(exact.fitted(n, 28))
        assert found[d, "SUM"] == number(sum(whole)) and found[d, "MIN"] == number(min(whole)) and found[d, "MAX"] == number(max(whole))
        assert found[d, "twice"] == number(sum(whole) + whole[0])
        assert found[d, "AVG"] == exact.shown(exact.divide(exact.fitted(sum(whole), 28), (len(own), 0)))
    assert [found[99, op] for op in ops] == ["0", "0", None, None]


def test_calculations_of_one_row_see_each_other(spark):
    """A result counts under its own name and the names above it, and only where the document has the field."""
    rows = [(1, "in.a", "2"), (1, "in.b", "5"), (1, "in.c", "7"), (2, "in.a", "1"), (2, "end", ""), (3, "in.b", "9"), (3, "end", "18")]
    fields = spark.createDataFrame(rows, "doc_id long, name string, value string")
    rules = [Calculation("in.b", expression="in.a * 2"), Calculation("in.c", "MAX", ("in",)), Calculation("end", "SUM", ("in",)), Calculation("end", expression="end + in.b")]
    found = {(r.doc_id, r.name): r.value for r in forms.recalculate(fields, rules).collect()}
    # 1: in.b 4, in.c 7 (as it was); 2: no in.b, so end is 1 + 0; 3: in.b 0, end 0
    assert found == {(1, "in.b"): "4", (2, "end"): "1", (3, "in.b"): "0", (3, "end"): "0"}


def scans(spark, name):
    return plan(spark, name).count("FileScan")


def test_cells_read_once(spark):
    """K7 reads its cells once, K7 and T2 work out no offsets, D4 joins nothing."""
    assert scans(spark, "K7_unassociated_cells") == 1 and "Join" not in plan(spark, "K7_unassociated_cells")
    assert all("aggregate(sequence" not in plan(spark, name) for name in ("K7_unassociated_cells", "T2_word_units"))
    assert "Join" not in plan(spark, "D4_word_coverage")


def test_headers_of_wide_cells(spark):
    """Every cell against every header of its table, one by one."""
    dice = random.Random(5)
    cells = [(d, t, r, c, dice.choice([1, 1, 2, 3]), dice.choice([1, 1, 2]), dice.choice(["TD", "TD", "TH"]), dice.choice(["Row", "Column", "Both", None, ""]), dice.random() < 0.2, dice.random() < 0.1)
             for d in range(6) for t in range(6) for r in range(0, 12, 3) for c in range(0, 8, 2) if dice.random() < 0.6]
    df = spark.createDataFrame(cells, "doc_id long, table_id int, row int, col int, row_span int, col_span int, type string, scope string, headers boolean, empty boolean")
    found = sorted(tuple(r)[:4] for r in accessibility.unassociated_cells(df).collect())
    meets = lambda a, n, b, m: a < b + m and b < a + n
    wanted = []
    for d, t, r, c, rs, cs, kind, _, headers, empty in cells:
        heads = [x for x in cells if x[:2] == (d, t) and x[6] == "TH"]
        read = any((x[7] in ("Row", "Both") and meets(r, rs, x[2], x[4])) or (x[7] in ("Column", "Both") and meets(c, cs, x[3], x[5])) for x in heads)
        if kind == "TD" and not headers and not empty and heads and not read:
            wanted.append((d, t, r, c))
    assert found == sorted(wanted) and found


def test_prefix_sums(spark):
    lists = [[3] * n for n in (0, 1, 15, 16, 17, 40, 5000)]
    rows = spark.createDataFrame([(v,) for v in lists], "v array<int>").select("v", arrays.exclusive_prefix(F.col("v")).alias("p")).collect()
    assert all(r.p == [3 * i for i in range(len(r.v))] for r in rows)


def test_coverage_counts_repeats(spark):
    a = spark.createDataFrame([(1, "x")] * 3 + [(1, "y"), (2, "x")], "doc_id long, word string")
    b = spark.createDataFrame([(1, "x")] * 2 + [(1, "z"), (3, "x")], "doc_id long, word string")
    assert {(r.doc_id, r.words, r.found) for r in comparing.word_coverage(a, b).collect()} == {(1, 4, 2), (2, 1, 0)}


@pytest.mark.parametrize("name", ["F4_recalculate", "F7_derive"])
def test_form_sums_moved_once(spark, name):
    """A document's fields meet in one grouping by hash, as whole numbers; no list of parts is made of them."""
    text = plan(spark, name)
    assert "ObjectHashAggregate" not in text and "decimal(38" not in "".join(line for line in text.splitlines() if "HashAggregate" in line)
    assert text.count("Exchange hashpartitioning") == 1


def test_sums_side_by_side_as_by_rows(spark, monkeypatch):
    """Sums of whole-number pieces and vectors give what sums by rows give: short, long, signed, written in a style, null and unreadable numbers."""
    dice = random.Random(11)
    digits = lambda n: str(dice.randrange(10 ** (n - 1), 10**n))
    kinds = [lambda: digits(3), lambda: "-" + digits(2) + ".25", lambda: " 12. ", lambda: None, lambda: "twelve", lambda: "1.234,5", lambda: "+.5", lambda: "999999999.999999", lambda: "-" + digits(9) + "." + digits(6),
             lambda: digits(20), lambda: "-0." + digits(19), lambda: digits(15) + "." + digits(9), lambda: "1e3", lambda: "-2.5E-7", lambda: ""]
    rows = [(d, f"{g}.f{i}", dice.choice(kinds[: 3 + d % 13])(), d % 4) for d in range(150) for g in "ab" for i in range(1 + d % 4)]
    rows += [(d, n, dice.choice(["7", "", None]), 0) for d in range(150) for n in ("net", "end", "more", "rest") if dice.random() < 0.7] + [(d, "net", "5", 0) for d in range(0, 150, 9)] + [(999, "other", "1", 0)]
    fields = spark.createDataFrame(rows, "doc_id long, name string, value string, separator_style int").repartition(3)
    rules = [Calculation("net", expression="a - 10.5"), Calculation("end", "SUM", ("net", "a", "b")), Calculation("more", expression="end * net * 3 - -b"), Calculation("rest", expression="(more + end) / b - 1"), Calculation("none", "AVG", ("a",))]
    found = []
    for beside in (16, -1):
        monkeypatch.setattr(forms, "_BESIDE", beside)
        found.append([sorted(map(str, forms.recalculate(fields, r).collect())) for r in (rules[:3], rules[:4], rules)])
        found[-1] += [sorted(map(str, forms.derive(fields, "d", e).collect())) for e in ("a * 2 - b", "a * a * a / b", "a + 79228162514264337593543950335")]
    assert all(found[0])
    for a, b in zip(*found):
        assert [x for x in a if x not in b] == [x for x in b if x not in a] == []


def test_vectors_give_way_to_whole_numbers_of_any_length():
    """Steps that 64 bits may not hold are taken one by one, with the same results."""
    dice = random.Random(13)
    for e in ("a * b", "a + b - 3", "-(a * 2.5) + b * b", "a * b * a * b", "a / b + 1", "4611686018427387904 - a"):
        for most in (10, 10**9, 10**18):
            a, b = [exact.np.array([dice.randrange(-most, most) for _ in range(40)], exact.np.int64) for _ in "ab"]
            vectors = {"a": exact.Vector.of(a, 6), "b": exact.Vector.of(b, 2)}
            found = exact.compiled(e)(vectors, 40)
            texts = found.shown().to_pylist() if isinstance(found, exact.Vector) else list(map(exact.shown, found))
            lists = {k: [(int(n), p) for n in v] for k, v, p in (("a", a, 6), ("b", b, 2))}
            wanted = exact.compiled(e)(lists, 40)
            assert texts == list(map(exact.shown, wanted)), (e, most)


def test_quotients_rounded_once():
    """Halves to the even digit, at as many places as fit, against whole-number division."""
    dice = random.Random(17)
    for _ in range(20000):
        a, b = [(dice.choice([1, -1]) * dice.choice([dice.randrange(10 ** dice.randrange(1, 29)), 2 ** dice.randrange(60), 5 ** dice.randrange(20)]), dice.randrange(29)) for _ in "ab"]
        wanted = None
        if b[0]:
            up, down = a[0] * 10 ** b[1], b[0] * 10 ** a[1]
            wanted = next(((n, p) for p in range(28, -1, -1) if abs(n := exact._divided(up * 10**p, down)) < exact.LIMIT), None)
        assert exact.shown(exact.divide(a, b)) == exact.shown(wanted)
