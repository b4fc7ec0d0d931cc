"""Tables: aligned text, cell placement, typed columns and what an export counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import cellvalues
from quire.plans import walks
from quire.plans.checkpoints import stored

PAGE = ["doc_id", "page_no"]


def _same_row(row: tuple, base: float, size: float) -> tuple:
    """The row a box is on, the one above it being `row` (baseline and size of its first box, number)."""
    first, first_size, number = row
    if first is None or abs(first - base) > 0.3 * max(size, first_size):
        row = (base, size, number + 1)
    return row, (row[2],)


def grid_tables(boxes: DataFrame) -> DataFrame:
    """Tables without ruling lines: short texts `(doc_id, page_no, x, y, w, h, size, text)` in aligned columns.

    Rows of cells close under each other make a run; gaps that at most a sixth of its rows cross cut the
    columns. Returns `(doc_id, page_no, table_no, row, col, col_span, text)`.
    """
    content = boxes.groupBy(*PAGE).agg((F.max(F.col("x") + F.col("w")) - F.min("x")).alias("_width"), F.count(F.lit(1)).alias("_n")).where("_n >= 6")
    placed = boxes.join(content, PAGE).withColumn("_base", F.col("y") + F.col("h"))
    # Rows: boxes on the baseline of the row's first, within a third of the larger text size.
    rows = walks.walk(placed, PAGE, ["_base", "x"], ["_base", "size"], {"_row": "long"}, lambda: (None, 0.0, 0), _same_row)
    rows = rows.withColumn("_cell", F.col("w") <= F.greatest("_width", F.lit(1.0)) * 0.6)
    facts = rows.groupBy(*PAGE, "_row").agg(
        F.min("y").alias("_top"), F.max("_base").alias("_bottom"), F.max("size").alias("_size"), F.bool_and("_cell").alias("_cells"), F.count(F.lit(1)).alias("_k"))
    order = W.partitionBy(*PAGE).orderBy("_row")
    lag = lambda c: F.lag(c).over(order)
    joined = F.col("_cells") & lag("_cells") & (F.col("_top") - lag("_bottom") <= lag("_size") * 1.6)
    facts = facts.withColumn("_start", (~F.coalesce(joined, F.lit(False))).cast("int"))
    facts = facts.withColumn("_run", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = [*PAGE, "_run"]
    runs = facts.groupBy(*run).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("_k") >= 2).alias("_multi"), F.min("_row").alias("_first"))
    runs = runs.where("_rows >= 3 and _multi >= 3 and _multi >= 0.6 * _rows")
    members = rows.join(facts.select(*PAGE, "_row", "_run"), [*PAGE, "_row"]).join(runs, run)
    shape = members.groupBy(*run).agg(
        F.avg(F.length("text")).alias("_avg"), F.min("x").alias("_l"), F.max(F.col("x") + F.col("w")).alias("_r"), F.get(F.sort_array(F.collect_list("size")), F.floor(F.count(F.lit(1)) / 2).cast("int")).alias("_mid"))
    shape = shape.where("_avg <= 40")
    members = members.join(shape, run)

    # How many rows cover each strip: the boxes of a row are joined first, then only edges are counted.
    span = members.select(*run, "_row", "_rows", "_l", "_r", "_mid", F.floor(F.col("x") - F.col("_l")).alias("a"), F.ceil(F.col("x") + F.col("w") - F.col("_l")).alias("b"))
    across = W.partitionBy(*run, "_row").orderBy("a", "b")
    reach = F.max("b").over(across.rowsBetween(W.unboundedPreceding, -1))
    span = span.withColumn("_fresh", (reach.isNull() | (F.col("a") > reach)).cast("int"))
    span = span.withColumn("_piece", F.sum("_fresh").over(across.rowsBetween(W.unboundedPreceding, 0)))
    pieces = span.groupBy(*run, "_row", "_piece").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    edges = pieces.select(*run, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("_e"))
    edges = edges.groupBy(*run, "_e.at").agg(F.sum("_e.d").alias("d"))
    along = W.partitionBy(*run).orderBy("at")
    cover = edges.withColumns({"_c": F.sum("d").over(along.rowsBetween(W.unboundedPreceding, 0)), "to": F.lead("at").over(along)}).where("to is not null")
    cover = cover.join(runs.select(*run, "_rows"), run).withColumn("_low", F.col("_c") <= F.floor(F.col("_rows") / 6))
    cover = cover.withColumn("_strip", F.count_if(~F.col("_low")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    gaps = cover.where("_low").groupBy(*run, "_strip").agg(F.min("at").alias("a"), F.max("to").alias("b")).join(shape, run)
    gaps = gaps.where((F.col("a") > 0) & (F.col("b") < F.ceil(F.col("_r") - F.col("_l"))) & (F.col("b") - F.col("a") >= F.greatest(F.lit(6.0), F.col("_mid") * 0.8)))
    # Twenty gaps at most make a table, so the cut points of a run are a short array.
    cuts = gaps.groupBy(*run).agg(F.count(F.lit(1)).alias("_g"), F.sort_array(F.collect_list(F.col("_l") + (F.col("a") + F.col("b")) / 2)).alias("cuts")).where("_g <= 20")
    cells = members.join(cuts, run)
    column = lambda x: F.size(F.filter("cuts", lambda c: c <= x))
    cells = cells.withColumns({"from": column(F.col("x") + 1), "to": column(F.col("x") + F.col("w") - 1), "mid": column(F.col("x") + F.col("w") / 2)})
    filled = cells.select(*run, "_row", "_rows", "mid").distinct().groupBy(*run, "mid", "_rows").agg(F.count(F.lit(1)).alias("_f"))
    good = filled.where("_f >= 0.5 * _rows").groupBy(*run).agg(F.count(F.lit(1)).alias("_full")).where("_full >= 2").select(*run)
    cells = cells.join(good, run)
    # Texts whose columns touch share a cell.
    side = W.partitionBy(*run, "_row").orderBy("from", "x")
    before = F.max("to").over(side.rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("_fresh", (before.isNull() | (F.col("from") > before)).cast("int"))
    cells = cells.withColumn("_cellno", F.sum("_fresh").over(side.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda s: s["text"]), "\n")
    out = cells.groupBy(*run, "_first", "_row", "_cellno").agg(F.min("from").alias("col"), F.max("to").alias("_to"), text.alias("text"))
    return out.select(
        *PAGE, F.dense_rank().over(W.partitionBy(*PAGE).orderBy("_run")).alias("table_no"), (F.col("_row") - F.col("_first")).alias("row"),
        "col", (F.col("_to") - F.col("col") + 1).alias("col_span"), "text")


def _place(state, cell):
    """One cell put in the first free square of its row; `busy` says until which row each column is taken."""
    row, span = cell["row"], cell["col_span"]
    begin = F.when(row == state["r"], state["c"]).otherwise(0)
    free = F.array_min(F.transform(state["busy"], lambda until, k: F.when((k >= begin) & (until <= row), k)))
    bound = F.array(F.coalesce(free, F.greatest(begin, F.size(state["busy"]))))  # bound once, used several times

    def put(at):
        wide = F.concat(state["busy"], F.array_repeat(F.lit(0), F.greatest(at + span - F.size(state["busy"]), F.lit(0))))
        busy = F.transform(wide, lambda until, k: F.when((k >= at) & (k < at + span), F.greatest(until, row + cell["row_span"])).otherwise(until))
        spot = F.struct(cell["ord"].alias("ord"), row.alias("row"), at.alias("col"))
        return F.struct(row.alias("r"), (at + span).alias("c"), busy.alias("busy"), F.concat(state["out"], F.array(spot)).alias("out"))

    return F.get(F.transform(bound, put), F.lit(0))


def place_cells(cells: DataFrame) -> DataFrame:
    """The column of each cell of rows given in order `(doc_id, table_id, row, ord, row_span, col_span)`.

    A cell takes the first square of its row that no span from above covers. A table's columns depend on
    all the cells before, so a table is walked as one value; tables are spread over the cluster.
    """
    rows = F.max("row").over(W.partitionBy("doc_id", "table_id")) + 1
    fitted = cells.withColumn("row_span", F.least("row_span", rows - F.col("row")))
    whole = lambda c, kind="int": F.col(c).cast(kind).alias(c)
    tables = fitted.groupBy("doc_id", "table_id").agg(
        F.array_sort(F.collect_list(F.struct(whole("row"), whole("ord", "bigint"), whole("row_span"), whole("col_span")))).alias("_cells"))
    start = F.struct(
        F.lit(-1).alias("r"), F.lit(0).alias("c"), F.array().cast("array<int>").alias("busy"),
        F.array().cast("array<struct<ord:bigint,row:int,col:int>>").alias("out"))
    placed = F.aggregate("_cells", start, _place, lambda state: state["out"])
    found = tables.select("doc_id", "table_id", F.explode(placed).alias("_p")).select("doc_id", "table_id", "_p.ord", "_p.row", "_p.col")
    return cells.join(found, ["doc_id", "table_id", "row", "ord"])


def occupied(cells: DataFrame) -> DataFrame:
    """The squares cells `(doc_id, table_id, row, col, row_span, col_span)` cover, with how many cells cover each."""
    over = lambda start, span: F.sequence(F.col(start), F.col(start) + F.col(span) - 1)
    squares = cells.withColumn("r", F.explode(over("row", "row_span"))).withColumn("c", F.explode(over("col", "col_span")))
    return squares.groupBy("doc_id", "table_id", "r", "c").agg(F.count(F.lit(1)).alias("cells"))


def table_shape(squares: DataFrame) -> DataFrame:
    """Per table whether cells overlap and whether its rows cover different numbers of columns."""
    per_row = squares.groupBy("doc_id", "table_id", "r").agg(F.count(F.lit(1)).alias("_w"), F.max("cells").alias("_m"))
    return per_row.groupBy("doc_id", "table_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_w").alias("narrowest"), F.max("_w").alias("widest"), (F.max("_m") > 1).alias("overlap"), (F.min("_w") != F.max("_w")).alias("ragged"))


def type_columns(cells: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Cells `(doc_id, table_id, row, col, text)` as Number, Date or Text, with the value and the format that shows it.

    Numeric dates are read as their column does: one part over 12 anywhere in it says which is the day;
    a column that says both says nothing. Cells are moved once, to their column, unless they are dealt out by document or
    table already, or by columns `also` that are the same in all of a table.
    """
    column = W.partitionBy(*also, "doc_id", "table_id", "col")
    says = lambda part: F.bool_or(F.col("_e") == part).over(column)
    shown = cells.withColumn("_e", cellvalues.date_evidence(cellvalues.normalized(F.col("text")))).withColumns({"_day": says("D"), "_month": says("M")})
    shown = shown.withColumn("_order", F.when(F.col("_day") & ~F.col("_month"), "D").when(F.col("_month") & ~F.col("_day"), "M"))
    s = F.col("_s")
    staged = shown.withColumn("_s", cellvalues.normalized(F.col("text")))
    fits = F.length(s).between(1, cellvalues.LONGEST)
    staged = cellvalues.with_number(staged, "_s", fits & F.substring(s, -1, 1).isin(*cellvalues.NUMBER_ENDS), "_number")
    staged = cellvalues.with_date(staged, "_s", F.col("_order"), fits & F.col("_number").isNull(), "_date")
    kind = F.when(F.col("_number").isNotNull(), "Number").when(F.col("_date").isNotNull(), "Date").otherwise("Text")
    return staged.select(
        *cells.columns, kind.alias("kind"), F.col("_number.value").alias("number"), F.col("_date.value").alias("date"),
        F.coalesce("_number.format", "_date.format", F.lit("")).alias("format"))


def sheet_names(typed: DataFrame, layout: str = "table") -> DataFrame:
    """The sheet each cell goes on: one per table, per page or per document."""
    name = {
        "table": F.concat(F.lit("Page "), "page_no", F.lit(" Table "), "table_no"),
        "page": F.concat(F.lit("Page "), "page_no"),
        "single": F.lit("Tables"),
    }[layout]
    return typed.withColumn("sheet", name)


def export_counts(typed: DataFrame) -> DataFrame:
    """Sheets, tables, cells, numbers, dates and merged cells of each document's export."""
    filled = F.col("text") != ""
    counts = {
        "merged": F.count_if((F.col("row_span") > 1) | (F.col("col_span") > 1)), "cells": F.count_if(filled),
        "numbers": F.count_if(filled & (F.col("kind") == "Number")), "dates": F.count_if(filled & (F.col("kind") == "Date"))}
    sums = [F.sum(c).alias(c) for c in counts]
    # A table is on one sheet, so tables add up over sheets.
    by_table = typed.groupBy("doc_id", "sheet", "table_id").agg(*[v.alias(k) for k, v in counts.items()])
    by_sheet = by_table.groupBy("doc_id", "sheet").agg(F.count(F.lit(1)).alias("tables"), *sums)
    return by_sheet.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sheets"), F.sum("tables").alias("tables"), *sums)


SHEET_ORDER = ["sheet", "doc_id", "table_id", "row", "col"]


def deal_to_sheets(rows: DataFrame) -> DataFrame:
    """Rows that cells are made of, with `(sheet, doc_id)` or `(sheet, doc_id, table_id)`, put in ranges of these, whole tables together.

    Ranges are found by a pass of their own, which is cheapest before cells are worked out.
    """
    return rows.repartitionByRange(_parts(rows), *[c for c in SHEET_ORDER[:3] if c in rows.columns])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_sheets(typed: DataFrame, folder: str, dealt: bool = False) -> None:
    """The cells of all documents in one folder per sheet name, ordered by document, table, row and column inside its files.

    Rows go to ranges of that order, so a name that most documents have fills as many files as it needs. Cells `dealt` by
    `deal_to_sheets` are written where they are; others are worked out once, before, as their ranges take a pass of their own.
    """
    ranged = typed if dealt else stored(typed, "cells").repartitionByRange(_parts(typed), *SHEET_ORDER)
    ranged.sortWithinPartitions(*SHEET_ORDER).write.partitionBy("sheet").parquet(folder)


def read_sheets(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What `write_sheets` wrote; a sheet asked for by name is the only folder read."""
    return spark.read.schema(schema).parquet(folder)


# ---- fixed values: the role of each structure type
ROLES = {
    "H1": "heading", "H2": "heading", "H3": "heading", "H4": "heading", "H5": "heading", "H6": "heading", "H": "heading", "Title": "heading",
    "P": "paragraph", "L": "list", "LI": "list_item", "TOCI": "list_item", "Table": "table", "TH": "table_header", "TD": "table_cell",
    "Figure": "figure", "Formula": "figure", "Caption": "caption", "BlockQuote": "quote", "Quote": "quote", "Code": "code", "Note": "note", "FENote": "note", "Link": "link",
}
# --------------------------------------------------


def structure_summary(elements: DataFrame) -> DataFrame:
    """How many elements `(doc_id, type)` of each role a document has."""
    role = F.lit(None).cast("string")
    for name, value in ROLES.items():
        role = F.when(F.col("type") == name, value).otherwise(role)
    names = sorted(set(ROLES.values()))
    return elements.withColumn("_role", role).groupBy("doc_id").agg(*[F.count_if(F.col("_role") == n).alias(n) for n in names])
