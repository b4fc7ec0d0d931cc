"""Values, forms, links, comments, revisions and metrics on fixtures with known answers."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import accessibility, arrange, comments, dedupe, forms, links, metrics, revisions, tables
from quire.operators.forms import Calculation, FieldRule
from quire.plans import blocks, folds, quantiles, sizes
from quire.sources import xfdf
from quire.streaming import arrivals


def cells(spark, columns):
    rows = [(1, 1, r, c, t) for c, column in enumerate(columns) for r, t in enumerate(column)]
    typed = tables.type_columns(spark.createDataFrame(rows, "doc_id long, table_id long, row int, col int, text string"))
    return {(r.col, r.row): r for r in typed.collect()}


def test_cell_numbers(spark):
    texts = ["1,234,567.89", "-42", "3.5", "2.50", "(15.25)", "− 7", "€1.234,56", "12 %", "£300"]
    values = [1234567.89, -42, 3.5, 2.5, -15.25, -7, 1234.56, 0.12, 300]
    found = cells(spark, [texts])
    assert [found[0, i].number for i in range(len(texts))] == values
    assert found[0, 3].format == "0.00" and found[0, 2].format == ""


def test_cell_text(spark):
    texts = ["02134", "1234567890123456", "555-1234", "(12", "12/03/2024", "2024-02-30", "Section 4"]
    found = cells(spark, [texts])
    assert {found[0, i].kind for i in range(len(texts))} == {"Text"}


def test_cell_dates(spark):
    found = cells(spark, [["25/12/2024", "12/03/2024"], ["12/25/2024", "03/04/2024"], ["5-Mar-2024", "March 5, 2024"], ["25/12/2024", "12/25/2024", ]])
    assert [str(found[0, i].date) for i in (0, 1)] == ["2024-12-25", "2024-03-12"]
    assert [str(found[1, i].date) for i in (0, 1)] == ["2024-12-25", "2024-03-04"]
    assert [(str(found[2, i].date), found[2, i].format) for i in (0, 1)] == [("2024-03-05", "d\\-mmm\\-yyyy"), ("2024-03-05", "mmmm d, yyyy")]


def show(spark, rule, value):
    row = forms.display_values(spark.createDataFrame([(1, rule.name, value)], "doc_id long, name string, value string"), [rule]).first()
    return row.text, row.red


def test_shown_values(spark):
    styles = [show(spark, FieldRule("n", "number", 2, s), "1234.5")[0] for s in range(4)]
    assert styles == ["1,234.50", "1234.50", "1.234,50", "1234,50"]
    assert show(spark, FieldRule("n", "number", 0, 4), "1234567.891")[0] == "1'234'568"
    assert show(spark, FieldRule("n", "number", 2, 0), "0.125")[0] == "0.13"
    assert show(spark, FieldRule("n", "number", 2, currency="$"), "1234.5")[0] == "$1,234.50"
    assert show(spark, FieldRule("n", "date", pattern="dd-mmm-yyyy"), "3/5/2026") == ("03-May-2026", False)
    assert show(spark, FieldRule("n", "special", special=2), "5551234567")[0] == "(555) 123-4567"
    assert show(spark, FieldRule("n", "percent", 1), "0.125")[0] == "12.5%"
    assert show(spark, FieldRule("n", "number", 2, 2, 3), "-1234.5") == ("(1.234,50)", True)


def test_checked_values(spark):
    rules = [FieldRule("price", "number", 2, currency="$", least=0, most=1000), FieldRule("phone", "special", special=2)]
    rows = spark.createDataFrame([("price", "$12.50"), ("price", "twelve"), ("price", "1500"), ("phone", "12345")], "name string, value string")
    found = {r.value: (r.stored, r.error) for r in forms.validate(rows, rules).collect()}
    assert found["$12.50"] == ("12.5", None)
    assert "number" in found["twelve"][1] and "1000" in found["1500"][1] and "phone" in found["12345"][1]


def fields(spark, **values):
    return spark.createDataFrame([(1, k.replace("__", "."), v) for k, v in values.items()], "doc_id long, name string, value string")


def test_calculated_fields(spark):
    rules = [Calculation("total", "PRD", ("qty", "price")), Calculation("subtotal", "SUM", ("total", "extra"))]
    found = {r.name: r.value for r in forms.recalculate(fields(spark, qty="3", price="0.1", extra="10", total="", subtotal=""), rules).collect()}
    assert found == {"total": "0.3", "subtotal": "10.3"}


def test_expressions(spark):
    rows = fields(spark, a="1", b="3", qty="5").unionByName(spark.createDataFrame([(1, "my field", "3")], "doc_id long, name string, value string"))
    value = lambda e: forms.derive(rows, "x", e).first().result
    assert value("qty / 0") is None
    assert value("(a + b) * 2 - 1") == 7
    assert value("my\\ field + 1") == 4
    assert value("-a - (b - 4) / -(2)") == -1.5


def test_exact_calculations(spark):
    """Small factors, long products, thirds, and numbers that do not fit."""
    rows = fields(spark, a="0.0000004", b="3", one="1", big="79228162514264337593543950335", tiny="0.00000000000000000001")
    text = lambda e: forms.derive(rows, "x", e).first().text
    assert text("a * 1000000") == "0.4"
    assert text("one / b") == "0." + "3" * 28 and text("one / b * b") == "0." + "9" * 28
    assert text("big + 1") is None and text("big - 1") == "79228162514264337593543950334" and text("big / 2") == "39614081257132168796771975168"
    assert text("tiny * tiny") == "0" and text("2 * -b - -1") == "-5"
    for wrong in ("", "a b", "(a", "a)", "* a", "a +", "1.2.3", "a & b"):
        with pytest.raises(ValueError):
            forms.derive(rows, "x", wrong)


def test_products_in_order(spark):
    thirty = spark.createDataFrame([(1, f"f.{i}", "1.25", i) for i in range(30)], "doc_id long, name string, value string, seq int")
    assert forms.calculate(thirty, [Calculation("p", "PRD", ("f",))]).first().text == "807.7935669463160887416100508"
    # Rounded at every step, so the order shows: 0.5 at the last of 28 places goes to the even neighbour, or is doubled first.
    values = [("0." + "0" * 27 + "1", "0.5", "4"), ("0." + "0" * 27 + "1", "4", "0.5")]
    made = spark.createDataFrame([(d, f"f.{9 - i}", v, i) for d, row in enumerate(values) for i, v in enumerate(row)], "doc_id long, name string, value string, seq int")
    assert {r.doc_id: r.text for r in forms.calculate(made, [Calculation("p", "PRD", ("f",))]).collect()} == {0: "0", 1: "0." + "0" * 27 + "2"}
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("k"), F.when(F.col("id") < 30, "2").when(F.col("id") == 30, "-1").otherwise("1.0").alias("v"), "id")
    assert folds.product(rows, ["k"], ["id"], "v").first().product == str(-(2**30))
    grown = spark.range(300).select(F.lit(1).cast("long").alias("k"), F.lit("2").alias("v"), "id")
    assert folds.product(grown, ["k"], ["id"], "v").first().product is None


def test_separator_styles(spark):
    rows = spark.createDataFrame([(1, "n.a", "1.234,56", 2), (1, "n.b", "1,234.56", 0), (1, "n.c", "1234,5", 3), (1, "n.d", "", None)], "doc_id long, name string, value string, separator_style int")
    rules = [Calculation("sum", "SUM", ("n",)), Calculation("mean", "AVG", ("n",)), Calculation("most", "MAX", ("n",)), Calculation("least", "MIN", ("n",))]
    assert {r.name: r.text for r in forms.calculate(rows, rules).collect()} == {"sum": "3703.62", "mean": "925.905", "most": "1234.56", "least": "0"}


def test_links(spark):
    rows = [
        ("URI", None, "https://example.org/a?b=c#d"), ("URI", None, "  https://example.org/a  "), ("URI", None, "mailto:someone@example.org"), ("URI", None, "javascript:alert(1)"),
        ("Named", "NextPage", None), ("Named", "PrevPage", None), ("Named", "FirstPage", None), ("Named", "LastPage", None), ("Named", "Print", None),
        ("URI", None, "https://evil‮.example"), ("URI", None, "https:\\\\evil.example"), ("URI", None, "https:///nohost")]
    df = spark.createDataFrame([(1, i, a, n, u, None, 5) for i, (a, n, u) in enumerate(rows)], "doc_id long, ord int, action string, name string, uri string, target_page int, page_count int")
    kinds = [r.kind for r in links.classify_links(df).orderBy("ord").collect()]
    assert kinds == ["WebUri"] * 3 + ["BlockedUri", "NextPage", "PreviousPage", "FirstPage", "LastPage", "External"] + ["BlockedUri"] * 3


def test_safety(spark):
    html = "<script>x</script>" * 12 + '<iframe src="a"></iframe><a href="file:///etc">f</a>'
    pages = spark.createDataFrame([(1, 1, "https://a.example", html)] + [(2, i, "https://b.example", "") for i in range(1, 52)], "doc_id long, page_no int, url string, html string")
    report = links.safety_report(links.active_items(pages), links.MAX_DETAILS, links.MAX_PAGES)
    found = {(r.doc_id, r.kind): r for r in report.collect()}
    assert found[1, "JavaScript"]["count"] == 12 and len(found[1, "JavaScript"].details) == 10
    assert {found[1, k].severity for k in ("JavaScript", "EmbeddedFile", "LaunchAction")} == {"Elevated"}
    assert found[2, "ExternalLink"]["count"] == 50 and found[2, "ExternalLink"].severity == "Informational"
    verdicts = {r.doc_id: (r.clean, r.limited) for r in links.safety_verdicts(pages, report, links.MAX_PAGES).collect()}
    assert verdicts == {1: (False, False), 2: (True, True)}
    clean = links.sanitize(pages)
    assert {r.verdict for r in clean.collect()} == {"clean"}
    assert links.active_items(clean.select("doc_id", "page_no", "url", "html")).where("kind <> 'ExternalLink'").count() == 0


def test_thread_roots(spark):
    chain = [(1, i, i - 1 if i > 1 else None, "R") for i in range(1, 67)]
    rows = chain + [(2, 1, 2, "R"), (2, 2, 1, "R"), (3, 5, 99, "R"), (4, 1, None, None), (4, 2, 1, None), (4, 3, 1, "Group")]
    table = spark.createDataFrame(rows, "doc_id long, id long, reply_to long, reply_type string")
    found = comments.thread_roots(table, 64)
    depth = {(r.doc_id, r.id): (r.root_id, r.depth) for r in found.collect()}
    assert {k for k in depth if k[0] in (2, 3)} == set()
    assert depth[1, 65] == (1, 64) and (1, 66) not in depth and depth[4, 2] == (1, 1) and (4, 3) not in depth
    assert {r.id: r.depth for r in comments.thread_roots(table).where("doc_id = 1").collect()}[66] == 65


def test_revision_verdicts(spark):
    rows = [(0, 2, 1), (1, 4, 2), (2, 2, 2), (3, 4, 3), (4, 16, None), (5, 32, 1), (6, 64, 1)]
    df = spark.createDataFrame(rows, "doc_id int, changes int, level int").withColumns({
        "integrity": F.lit(True), "lock_broken": F.lit(False), "unverifiable": F.lit(False)})
    found = [r.verdict for r in revisions.verdict(df).orderBy("doc_id").collect()]
    changed, allowed = "ModifiedAfterSigning", "ValidWithPermittedChanges"
    assert found == [changed, changed, allowed, allowed, changed, "Valid", "Valid"]


def test_timings(spark):
    sets = {"a": range(100, 1001, 100), "b": range(1, 21), "c": [900, 100, 500, 300, 700], "d": [1, 3, 5, 9], "e": [math.nan, 2]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in sets.items() for v in vs], "k string, value double")
    found = {r.k: r for r in metrics.summarize(df, ["k"]).collect()}
    assert found["a"].p95 == 1000 and found["b"].p95 == 19 and (found["c"]["median"], found["c"]["mean"]) == (500, 500) and found["d"]["median"] == 4
    assert (found["e"].refused, found["e"]["count"]) == (1, 1)
    half = quantiles.at_ranks(df.where("k = 'a'"), ["k"], "value", {"p50": metrics.nearest_rank(50)}).first()
    assert half.p50 == 500


def test_gate_and_inventory(spark):
    measure = lambda **v: spark.createDataFrame([(k, float(x)) for k, x in v.items()], "measure string, value double")
    rules = sizes.rules(spark, [("a", "at_most_limit", 0.5, 250.0), ("b", "at_most_limit", 0.5, 250.0)], "measure string, rule string, relative double, absolute double")
    found = {r.measure: r for r in metrics.gate(measure(a=1000, b=1000), measure(a=1750, b=1750.1), rules).collect()}
    assert found["a"].limit == 1750 and found["a"].verdict == "passed" and found["b"].verdict == "failed"
    files = lambda **v: spark.createDataFrame(list(v.items()), "path string, bytes long")
    diff = metrics.inventory_diff(files(a=10, b=10, gone=5), files(a=30, b=11, new2=7, new1=7), 10).orderBy("change", "rank").collect()
    assert [(r.change, r.path) for r in diff] == [("added", "new1"), ("added", "new2"), ("changed", "a"), ("changed", "b"), ("removed", "gone")]


def test_headings_nesting_aliases(spark):
    heads = spark.createDataFrame([(d, 0, i, f"H{n}") for d, ns in enumerate([[2, 3], [1, 3], [1, 2, 3]]) for i, n in enumerate(ns)], "doc_id long, parent_id long, ord long, type string")
    assert {(r.doc_id, r.rule) for r in accessibility.check_headings(heads).collect()} == {(0, "14-002"), (1, "14-003")}
    tree = spark.createDataFrame([(1, 1, 0, 1, "Document"), (1, 2, 1, 1, "TR"), (1, 3, 2, 1, "TD")], "doc_id long, id long, parent_id long, ord int, type string")
    assert [(r.id, r.rule) for r in accessibility.check_nesting(tree).collect()] == [(2, "09-004")]
    alias = spark.createDataFrame([(1, "A", "B"), (1, "B", "A"), (1, "X", "P"), (1, "P", "Sect")], "doc_id long, type string, target string")
    found = {r.type: r.status for r in accessibility.resolve_aliases(alias, alias.select("doc_id", "type")).collect() if r.status != "standard"}
    assert found == {"A": "02-003", "B": "02-003", "X": "mapped", "P": "02-004"}


def test_templates(spark):
    row = spark.createDataFrame([(1, 2, 7)], "doc_id long, page int, n int")
    text = arrange.expand_template("<<Page 1 of n>>|<<Date>> | <<d/m/yy>> | <<File>> | <<Bates>> | <<unknown>>", F.col("page"), F.col("n"), F.lit("B01"), F.lit("2026-09-28").cast("date"), F.lit("a.pdf"))
    assert row.select(text.alias("t")).first().t == "Page 2 of 7|2026-09-28 | 28/9/26 | a.pdf | B01 | <<unknown>>"


def test_arranging_back_and_forth(spark):
    pages = spark.createDataFrame([(1, p, 612.0, 792.0, 90 * p % 360) for p in range(1, 8)], "doc_id long, page_no long, width double, height double, rotation int")
    same = arrange.arrange(pages, pages.select("doc_id", F.col("page_no").alias("ord"), F.col("page_no").alias("source_page"), F.lit(0).alias("turn")))
    assert sorted(r.page_no for r in same.where("page_no = source_page").collect()) == list(range(1, 8))
    parts = arrange.split(pages, spark.createDataFrame([(1, 1, 3), (1, 2, 4)], "doc_id long, part int, pages int"))
    assert [(r.part, r.page_no) for r in parts.orderBy("source_page").collect()] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4)]


def test_duplicates(spark):
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "y")], "id long, hash string")
    refs = spark.createDataFrame([(3, 0, 1), (4, 0, 2), (5, 0, 3)], "id long, slot int, target long")
    assert {(r.id, r.keep_id) for r in dedupe.dedupe_refs(items, refs).collect()} == {(2, 1), (4, 3)}
    once = dedupe.dedupe_exact(items.withColumn("bytes", F.lit(1)))
    left = once.where("id = keep_id").drop("keep_id")
    assert dedupe.duplicate_groups(left).count() == 0


def test_blocks_equal_plain_windows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 501).alias("p"), (F.col("id") % 11).alias("v"))
    plain = spark.createDataFrame(df.collect()).selectExpr(
        "k", "p", "sum(v) over (partition by k order by p) as s", "lag(v) over (partition by k order by p) as b", "lead(v) over (partition by k order by p) as a",
        "max(v) over (partition by k order by p rows between unbounded preceding and 1 preceding) as m", "cast(row_number() over (partition by k order by p) as bigint) as n")
    outs = dict(s=("sum", "v"), b=("prev", "v"), a=("next", "v"), m=("max_before", "v"), n=("number", None))
    for cut in (blocks.by_value(df, "p", 13), blocks.by_range(df, ["k"], ["p"])):
        found = blocks.scan(cut, ["k"], ["p"], **outs).drop("v")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_xfdf(spark, tmp_path):
    comment_rows = spark.createDataFrame(
        [(1, 1, "Text", 3, [1.0, 2.0, 3.0, 4.0], "Ann <x>", "n1", "2024", None, None, None, 'a & "b"'), (1, 2, "Stamp", 1, [0.0, 0.0, 1.0, 1.0], "Bo", "n2", "2025", "n1", "Accepted", "Review", "")],
        "doc_id long, ord long, subtype string, page_no int, rect array<double>, author string, name string, created string, reply_to string, state string, state_model string, contents string")
    xfdf.write_texts(xfdf.comments_as_xfdf(comment_rows), f"{tmp_path}/c")
    back = {r.name: r for r in xfdf.read_comments(spark, f"{tmp_path}/c/*/*.txt").collect()}
    assert back["n1"].author == "Ann <x>" and back["n1"].page_no == 3 and back["n1"].contents == 'a & "b"' and back["n1"].rect == [1.0, 2.0, 3.0, 4.0]
    assert (back["n2"].state, back["n2"].reply_to, back["n2"].subtype) == ("Accepted", "n1", "Stamp")
    nested = '<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields><field name="a"><field name="b"><value>1</value></field></field><field name="c.d"><value>2</value><value>3</value></field></fields></xfdf>'
    (tmp_path / "f.xml").write_text(nested)
    assert {r.name: r["values"] for r in xfdf.read_fields(spark, f"{tmp_path}/f.xml").collect()} == {"a.b": ["1"], "c.d": ["2", "3"]}


def test_no_limits_on_depth(spark):
    chain = [(1, f"A{i}", f"A{i + 1}") for i in range(99)] + [(1, "A99", "P"), (2, "B", "C"), (2, "C", "B")]
    alias = spark.createDataFrame(chain, "doc_id long, type string, target string")
    found = {(r.doc_id, r.type): r.status for r in accessibility.resolve_aliases(alias, alias.select("doc_id", "type")).collect()}
    assert {found[1, f"A{i}"] for i in range(100)} == {"mapped"} and found[2, "B"] == "02-003"
    nested = "x<scr<scr<scr<script>a</script>ipt>b</script>ipt>c</script>ipt>d</script>y"
    pages = spark.createDataFrame([(1, p, "", nested if p == 1 else '<a href="file:///x">f</a>' if p == 60 else "") for p in range(1, 61)], "doc_id long, page_no int, url string, html string")
    clean = {r.page_no: (r.html, r.verdict) for r in links.sanitize(pages).collect()}
    assert clean[1] == ("xy", "clean")
    assert {r.kind for r in links.safety_report(links.active_items(pages)).collect()} == {"JavaScript", "LaunchAction"}
    depth = 9
    items = spark.createDataFrame([(10 * c + k, "leaf" if k == 0 else f"node{k}") for c in (1, 2) for k in range(depth)], "id long, hash string")
    refs = spark.createDataFrame([(10 * c + k, 0, 10 * c + k - 1) for c in (1, 2) for k in range(1, depth)], "id long, slot int, target long")
    assert {(r.id, r.keep_id) for r in dedupe.dedupe_refs(items, refs).collect()} == {(20 + k, 10 + k) for k in range(depth)}


def test_null_groups_carry_over_blocks(spark):
    rows = spark.createDataFrame([(None if i % 2 else 1, i) for i in range(100)], "k long, v long")
    got = blocks.scan(blocks.by_value(rows, "v", 10), ["k"], ["v"], no=("number", None), upto=("sum", "v")).orderBy("v").collect()
    assert [r.no for r in got] == [i // 2 + 1 for i in range(100)]
    assert [r.upto for r in got] == [sum(range(i % 2, i + 1, 2)) for i in range(100)]


def test_pages_that_arrive_later(spark, tmp_path):
    page = lambda d, n, html: (d, n, "", html)
    schema = "doc_id long, page_no int, url string, html string"
    script = "<script>s</script>"
    batches = [[page(1, 1, script), page(2, 1, "")], [page(1, 2, script * 2), page(1, 1, script)], [page(2, 2, script)]]
    counts = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        arrivals.inspect_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        counts.append({r.doc_id: r["count"] for r in arrivals.findings_so_far(spark, str(tmp_path / "out")).collect()})
    assert counts == [{1: 1}, {1: 3}, {1: 3, 2: 1}]


def test_recent_lists_as_a_stream(spark, tmp_path):
    """Five batches, the last of them run twice, give what one batch over everything gives."""
    dice = random.Random(7)
    rows = [(i % 3, f"doc{dice.randrange(9)}", datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=dice.randrange(500)), i, dice.randrange(1, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, location string, opened_at timestamp, seq long, page long")
    df.repartition(5, "seq").write.parquet(f"{tmp_path}/in")

    def run():
        opened = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        arrivals.recent_stream(opened, f"{tmp_path}/out", f"{tmp_path}/state", 4).awaitTermination()
        return sorted(tuple(r) for r in arrivals.recent_so_far(spark, f"{tmp_path}/out").select("user_id", "location", "seq", "page", "rank").collect())

    want = sorted(tuple(r) for r in metrics.recent(df, 4).select("user_id", "location", "seq", "page", "rank").collect())
    assert run() == want
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    assert last == 4
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    assert run() == want
