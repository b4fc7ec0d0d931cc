"""Tables and typed values (E10, E11, V) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import derived
from quire.catalog.base import query, table
from quire.plans.checkpoints import new_folder
from quire.operators import tables


@query("E10_grid_tables", f"""
WITH {derived.LINES},
b AS (SELECT doc_id, page_no, line_no, unnest([0, 1, 2]) AS col, unnest([left(text, 9), substring(text, 12, 6), substring(text, 20, 8)]) AS text FROM lines WHERE line_no % 12 <> 11 AND length(text) >= 28),
r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS rk FROM b),
g AS (SELECT *, line_no - rk AS run FROM r),
z AS (SELECT *, count(DISTINCT line_no) OVER (PARTITION BY doc_id, page_no, run) AS n, min(line_no) OVER (PARTITION BY doc_id, page_no, run) AS first, count(*) OVER (PARTITION BY doc_id, page_no) AS boxes FROM g)
SELECT doc_id, page_no::BIGINT AS page_no, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY run) AS table_no, (line_no - first)::BIGINT AS "row", col::BIGINT AS col, 1::BIGINT AS col_span, text
FROM z WHERE n >= 3 AND boxes >= 6
""")
def grid(spark, folder):
    """The beginnings of lines set in three columns; lines too short and every twelfth line leave a gap."""
    rows = derived.lines(spark, folder).where("line_no % 12 <> 11 and length(text) >= 28")
    piece = lambda i, start, n: F.struct(F.lit(72.0 + 150 * i).alias("x"), F.substring("text", start, n).alias("text"), F.lit(6.0 * n).alias("w"))
    boxes = rows.select("doc_id", "page_no", "y", "h", "size", F.explode(F.array(piece(0, 1, 9), piece(1, 12, 6), piece(2, 20, 8))).alias("_p"))
    return tables.grid_tables(boxes.select("doc_id", "page_no", "y", "h", F.lit(11.0).alias("size"), "_p.*"))


_SPANS = """
cells AS (SELECT o_custkey AS doc_id, o_orderkey // 40 AS table_id, o_orderkey % 5 AS "row", o_orderkey // 5 % 8 * 2 AS col, 1 + (o_orderkey % 3 = 0 AND o_orderkey % 5 < 4)::INT AS row_span, 1 + o_orderkey % 2 AS col_span FROM orders),
sq AS (SELECT 0 AS doc_id, table_id, r, c, count(*) AS cells FROM cells, range(0, 2) a(i), range(0, 2) b(j), LATERAL (SELECT "row" + i AS r, col + j AS c) WHERE i < row_span AND j < col_span GROUP BY ALL)"""


def _cells(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.lit(0).cast("long").alias("doc_id"), F.floor(key / 40).alias("table_id"), (key % 5).alias("row"), (F.floor(key / 5) % 8 * 2).alias("col"),
        (1 + ((key % 3 == 0) & (key % 5 < 4)).cast("int")).alias("row_span"), (1 + key % 2).alias("col_span"), key.alias("ord"))


@query("E11_occupied", f"WITH {_SPANS} SELECT doc_id::BIGINT AS doc_id, table_id, r, c, cells FROM sq")
def occupied(spark, folder):
    return tables.occupied(_cells(spark, folder))


@query("E11_table_shape", f"""
WITH {_SPANS}, p AS (SELECT doc_id, table_id, r, count(*) AS w, max(cells) AS m FROM sq GROUP BY ALL)
SELECT doc_id::BIGINT AS doc_id, table_id, count(*) AS rows, min(w) AS narrowest, max(w) AS widest, max(m) > 1 AS overlap, min(w) <> max(w) AS ragged FROM p GROUP BY doc_id, table_id
""")
def shape(spark, folder):
    return tables.table_shape(tables.occupied(_cells(spark, folder)))


@query("E11_place_cells", """
SELECT 0::BIGINT AS doc_id, o_orderkey // 40 AS table_id, o_orderkey % 5 AS "row", o_orderkey AS ord,
       ((row_number() OVER (PARTITION BY o_orderkey // 40, o_orderkey % 5 ORDER BY o_orderkey) - 1) * 2)::BIGINT + CASE WHEN o_orderkey % 5 = 1 THEN 1 ELSE 0 END AS col
FROM orders
""")
def place(spark, folder):
    """Cells two columns wide; the second row of each table is led by a cell of one column."""
    key = F.col("o_orderkey")
    cells = table(spark, folder, "orders").select(
        F.lit(0).cast("long").alias("doc_id"), F.floor(key / 40).alias("table_id"), (key % 5).alias("row"), key.alias("ord"), F.lit(1).alias("row_span"), F.lit(2).alias("col_span"), F.lit(False).alias("lead"))
    # Before all cells of its table, whatever the keys are.
    lead = cells.groupBy("doc_id", "table_id").agg(F.lit(1).cast("long").alias("row"), (F.min("ord") - 1).alias("ord"))
    lead = lead.withColumns({"row_span": F.lit(1), "col_span": F.lit(1), "lead": F.lit(True)})
    return tables.place_cells(cells.unionByName(lead)).where("not lead").select("doc_id", "table_id", "row", "ord", "col")


_VALUES = """
v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice + 1000, 2) AS p, l_quantity AS q, l_shipdate::DATE AS d, (l_partkey + l_linenumber) % 6 AS k, l_orderkey % 3 AS t FROM lineitem),
o AS (SELECT l_orderkey, bool_or(day(d) > 12) AS known FROM v GROUP BY l_orderkey),
typed AS (
  SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS row, 0 AS col, 'Number' AS kind, CASE WHEN k IN (1, 4) THEN -p WHEN k = 5 THEN q / 100 ELSE p END AS number, NULL::DATE AS date,
         CASE k WHEN 0 THEN '#,##0.00' WHEN 1 THEN '#,##0.00;\\(#,##0.00\\)' WHEN 2 THEN '"$"#,##0.00' WHEN 3 THEN '#,##0.00\\ "€"' WHEN 4 THEN '#,##0.00' ELSE '0%' END AS format FROM v
  UNION ALL SELECT l_orderkey, l_linenumber, 1, CASE WHEN known OR t = 2 THEN 'Date' ELSE 'Text' END, NULL, CASE WHEN known OR t = 2 THEN d END,
         CASE WHEN t = 2 THEN 'yyyy\\-mm\\-dd' WHEN NOT known THEN '' WHEN t = 0 THEN 'dd/mm/yyyy' ELSE 'mm/dd/yyyy' END FROM v JOIN o USING (l_orderkey)
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 'Text', NULL, NULL, '' FROM v)""".replace("\\\\", "\\")


def _typed(spark, folder, sheets: bool = False):
    """Line items as tables of three columns: prices written in six ways, dates in the order's own way, and codes.

    Items are dealt out before their cells are rows, by order, or by sheet and order; `sheets` names the sheets.
    """
    key = F.col("l_orderkey")
    page, number = (key % 7 + 1, F.floor(key / 7) % 3 + 1) if sheets else (F.lit(1), F.lit(1))
    v = table(spark, folder, "lineitem").select(
        key.alias("doc_id"), page.alias("page_no"), number.alias("table_no"), "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    v = tables.deal_to_sheets(tables.sheet_names(v)) if sheets else v.repartition("doc_id")
    price = F.call_function("format_number", F.round(F.col("l_extendedprice") + 1000, 2), F.lit("#,##0.00"))
    european = F.translate(price, ",.", ".,")
    k = (F.col("l_partkey") + F.col("l_linenumber")) % 6
    number = (
        F.when(k == 0, price).when(k == 1, F.concat(F.lit("("), price, F.lit(")"))).when(k == 2, F.concat(F.lit("$"), price)).when(k == 3, F.concat(european, F.lit(" €")))
        .when(k == 4, F.concat(F.lit("−"), price)).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" %"))))
    shipped = F.col("l_shipdate")
    t = F.col("doc_id") % 3
    date = F.when(t == 0, F.date_format(shipped, "dd/MM/yyyy")).when(t == 1, F.date_format(shipped, "MM/dd/yyyy")).otherwise(F.date_format(shipped, "yyyy-MM-dd"))
    code = F.concat(F.lit("0"), (F.col("l_partkey") + 1).cast("string"))
    entry = lambda col, text: F.struct(F.lit(col).alias("col"), text.alias("text"))
    own = ["sheet"] if sheets else []
    cells = v.select(
        *own, "doc_id", F.lit(1).alias("table_id"), "page_no", "table_no", F.col("l_linenumber").alias("row"), F.lit(1).alias("row_span"),
        F.when(F.col("l_linenumber") == 7, 2).otherwise(1).alias("col_span"), F.explode(F.array(entry(0, number), entry(1, date), entry(2, code))).alias("_c"))
    return tables.type_columns(cells.select("*", "_c.*").drop("_c"), own)


@query("V1_type_columns", f"""
WITH {_VALUES}
SELECT doc_id, row, col::BIGINT AS col, kind, round(coalesce(number, 0), 6) AS number, coalesce(date::VARCHAR, '') AS date, format FROM typed
""")
def typed(spark, folder):
    return _typed(spark, folder).select(
        "doc_id", "row", "col", "kind", F.round(F.coalesce("number", F.lit(0.0)), 6).alias("number"), F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), "format")


@query("V2_export_counts", f"""
WITH {_VALUES}, m AS (SELECT l_orderkey AS doc_id, 3 * count(*) FILTER (l_linenumber = 7) AS merged FROM lineitem GROUP BY ALL)
SELECT doc_id, 1::BIGINT AS sheets, 1::BIGINT AS tables, any_value(merged) AS merged, count(*) AS cells, count(*) FILTER (kind = 'Number') AS numbers, count(*) FILTER (kind = 'Date') AS dates
FROM typed JOIN m USING (doc_id) GROUP BY doc_id
""")
def export_counts(spark, folder):
    return tables.export_counts(tables.sheet_names(_typed(spark, folder)))


@query("V2_sheets", f"""
WITH {_VALUES}
SELECT 'Page ' || (doc_id % 7 + 1) || ' Table ' || (doc_id // 7 % 3 + 1) AS sheet, doc_id, count(*) AS cells, count(*) FILTER (kind = 'Number') AS numbers, count(*) FILTER (kind = 'Date') AS dates
FROM typed GROUP BY ALL
""")
def sheets(spark, folder):
    """Typed cells written as sheets, read back and counted."""
    named = _typed(spark, folder, sheets=True)
    place = new_folder(spark, "sheets")
    tables.write_sheets(named, place, dealt=True)
    return tables.read_sheets(spark, place, named.schema).groupBy("sheet", "doc_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("kind") == "Number").alias("numbers"), F.count_if(F.col("kind") == "Date").alias("dates"))


@query("V3_structure_summary", r"""
WITH t AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?i)<(h[1-6]|p|ul|ol|li|table|th|td|img|a|code|blockquote)\b', 1)) AS tag FROM pages)
SELECT doc_id, count(*) FILTER (tag LIKE 'h_') AS heading, count(*) FILTER (tag = 'p') AS paragraph, count(*) FILTER (tag IN ('ul', 'ol')) AS list, count(*) FILTER (tag = 'li') AS list_item,
       count(*) FILTER (tag = 'table') AS "table", count(*) FILTER (tag = 'th') AS table_header, count(*) FILTER (tag = 'td') AS table_cell, count(*) FILTER (tag = 'img') AS figure,
       count(*) FILTER (tag = 'a') AS link, count(*) FILTER (tag = 'code') AS code, count(*) FILTER (tag = 'blockquote') AS quote, 0::BIGINT AS caption, 0::BIGINT AS note
FROM t GROUP BY doc_id
""")
def structure(spark, folder):
    tags = {"p": "P", "ul": "L", "ol": "L", "li": "LI", "table": "Table", "th": "TH", "td": "TD", "img": "Figure", "a": "Link", "code": "Code", "blockquote": "BlockQuote"}
    found = table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<(h[1-6]|p|ul|ol|li|table|th|td|img|a|code|blockquote)\b"), F.lit(1))).alias("tag"))
    kind = F.upper("tag")
    for tag, name in tags.items():
        kind = F.when(F.lower("tag") == tag, name).otherwise(kind)
    return tables.structure_summary(found.select("doc_id", kind.alias("type")))
