"""Checks of structure: headings, ids, table headers, descriptions, nesting and type aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans import blocks, closure, sizes

# ---- fixed values --------------------------------------------------------------------------------
LANGUAGE_TAG = r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"
STANDARD_TYPES = (
    "Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private",
    "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot",
    "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Ruby", "RB", "RT", "RP", "Warichu", "WT", "WP",
    "Figure", "Formula", "Form",
)
# Rule ids by the family of the element.
NESTING_RULES = {"Table": "09-004", "L": "09-005", "TOC": "09-006"}
# What may stand directly inside an element.
CHILDREN = {
    "Table": ("TR", "THead", "TBody", "TFoot", "Caption"), "TR": ("TH", "TD"), "THead": ("TR",), "TBody": ("TR",), "TFoot": ("TR",),
    "L": ("LI", "L", "Caption"), "LI": ("Lbl", "LBody"), "TOC": ("TOCI", "TOC", "Caption"),
}
# What an element must stand directly in.
PARENTS = {
    "TR": ("Table", "THead", "TBody", "TFoot"), "THead": ("Table",), "TBody": ("Table",), "TFoot": ("Table",), "TH": ("TR",), "TD": ("TR",),
    "LI": ("L",), "LBody": ("LI",), "TOCI": ("TOC",),
}
FAMILY = {t: "Table" for t in ("Table", "TR", "THead", "TBody", "TFoot", "TH", "TD")} | {t: "L" for t in ("L", "LI", "LBody")} | {t: "TOC" for t in ("TOC", "TOCI")}
# --------------------------------------------------------------------------------------------------


def check_headings(headings: DataFrame, width: int = 65536) -> DataFrame:
    """Findings on headings `(doc_id, parent_id, ord, type)`: first not H1, skipped levels, H beside H1-H6, two H in one element."""
    numbered = headings.where(F.col("type").rlike("^H[1-6]$")).withColumn("level", F.substring("type", 2, 1).cast("int"))
    seen = blocks.scan(blocks.by_value(numbered, "ord", width), ["doc_id"], ["ord"], _before=("prev", "level"))
    rule = F.when(F.col("_before").isNull() & (F.col("level") != 1), "14-002").when(F.col("level") > F.col("_before") + 1, "14-003")
    order = seen.withColumn("rule", rule).where("rule is not null").select("doc_id", "rule", "ord")
    mixed = headings.groupBy("doc_id").agg(
        F.count_if(F.col("type") == "H").alias("_h"), F.min(F.when(F.col("type") != "H", F.col("ord"))).alias("ord")).where("_h > 0 and ord is not null")
    double = headings.where("type = 'H'").groupBy("doc_id", "parent_id").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("ord")).where("_n > 1")
    return order.unionByName(mixed.select("doc_id", F.lit("14-007").alias("rule"), "ord")).unionByName(double.select("doc_id", F.lit("14-006").alias("rule"), "ord"))


def duplicate_ids(items: DataFrame) -> DataFrame:
    """Ids used more than once in a document; every use after the first is a finding. Missing ids are counted too."""
    groups = items.groupBy("doc_id", F.coalesce("id", F.lit("")).alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    rule = F.when(F.col("id") == "", "19-003").when(F.col("_n") > 1, "19-004")
    found = F.when(F.col("id") == "", F.col("_n")).otherwise(F.col("_n") - 1)
    return groups.select("doc_id", "id", rule.alias("rule"), found.alias("count")).where("rule is not null")


def unassociated_cells(cells: DataFrame) -> DataFrame:
    """Data cells `(doc_id, table_id, row, col, row_span, col_span, type, scope, headers, empty)` no header can be read with.

    Headers and cells meet on the row or column squares they cover, so a table's cells are never paired
    with all of its headers. Cells are read and moved once, to the task of their table, and stand there once for every
    row and column they cover. Tables without header cells are left alone.
    """
    key = ["doc_id", "table_id"]
    head = F.col("type") == "TH"
    over = lambda axis, start, span: F.transform(F.sequence(F.col(start), F.col(start) + F.col(span) - 1), lambda n: F.struct(F.lit(axis).alias("axis"), n.alias("at")))
    data = (F.col("type") == "TD") & ~F.col("empty") & ~F.col("headers")
    squares = cells.where(data | head).withColumn("_s", F.explode(F.concat(over("row", "row", "row_span"), over("col", "col", "col_span")))).repartition(*key)
    reads = head & F.when(F.col("_s.axis") == "row", F.col("scope").isin("Row", "Both")).otherwise(F.col("scope").isin("Column", "Both"))
    square = W.partitionBy(*key, "_s.axis", "_s.at")
    seen = squares.withColumn("_read", F.max(F.coalesce(reads, F.lit(False))).over(square)).withColumn("_headed", F.max(head).over(W.partitionBy(*key)))
    return seen.where(data & F.col("_headed")).groupBy(*cells.columns).agg(F.max("_read").alias("_read")).where(~F.col("_read")).select(*cells.columns)


def check_descriptions(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """Findings on missing titles and languages of `docs (doc_id, title, lang)` and descriptions of `elements (doc_id, ord, type, alt, lang)`."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad_tag = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(LANGUAGE_TAG)
    entry = lambda cond, rule: F.when(cond, F.lit(rule))
    doc_rules = F.array_compact(F.array(entry(blank("title"), "06-003"), entry(F.col("lang").isNull(), "11-001w"), entry(bad_tag("lang"), "11-001")))
    element_rules = F.array_compact(F.array(
        entry((F.col("type") == "Figure") & blank("alt"), "13-004"), entry((F.col("type") == "Formula") & blank("alt"), "17-002"),
        entry((F.col("type") == "Widget") & blank("alt"), "28-005"), entry((F.col("type") == "Link") & blank("alt"), "28-012"), entry(bad_tag("lang"), "11-001")))
    return docs.select("doc_id", F.lit(None).cast("long").alias("ord"), F.explode(doc_rules).alias("rule")).unionByName(
        elements.select("doc_id", F.col("ord").cast("long").alias("ord"), F.explode(element_rules).alias("rule")))


def count_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("count"))


def check_nesting(elements: DataFrame) -> DataFrame:
    """Findings on elements `(doc_id, id, parent_id, ord, type)` in the wrong place or with the wrong content.

    One join of each element with its parent; contents are then counted per parent.
    """
    spark = elements.sparkSession
    family = sizes.rules(spark, [(t, NESTING_RULES[f]) for t, f in FAMILY.items()], "_type string, rule string")
    inside = sizes.rules(spark, [(p, c) for p, cs in CHILDREN.items() for c in cs], "_ptype string, type string")
    under = sizes.rules(spark, [(c, p) for c, ps in PARENTS.items() for p in ps], "type string, _ptype string")
    above = elements.select("doc_id", F.col("id").alias("parent_id"), F.col("type").alias("_ptype"))
    placed = elements.join(above, ["doc_id", "parent_id"], "left").withColumn("_ptype", F.coalesce("_ptype", F.lit("")))
    rule_of = lambda df, column: df.join(family, F.col(column) == F.col("_type")).drop("_type")

    misplaced = rule_of(placed.where(F.col("type").isin(*PARENTS)).join(under, ["type", "_ptype"], "left_anti"), "type")
    foreign = placed.where(F.col("_ptype").isin(*CHILDREN) & F.col("type").isin(*STANDARD_TYPES)).join(inside, ["_ptype", "type"], "left_anti")
    foreign = rule_of(foreign.select("doc_id", F.col("parent_id").alias("id"), "_ptype").distinct(), "_ptype")

    count = lambda t: F.count_if(F.col("type") == t)
    held = placed.where("_ptype in ('Table', 'L', 'TOC')").groupBy("doc_id", F.col("parent_id").alias("id"), "_ptype").agg(
        count("Caption").alias("captions"), count("THead").alias("heads"), count("TFoot").alias("feet"), count("TBody").alias("bodies"),
        F.min("ord").alias("first"), F.max("ord").alias("last"), F.max(F.when(F.col("type") == "Caption", F.col("ord"))).alias("caption"))
    table = F.col("_ptype") == "Table"
    wrong_end = (F.col("captions") == 1) & (F.col("caption") != F.col("first")) & (~table | (F.col("caption") != F.col("last")))
    problems = F.array_compact(F.array(
        F.when(F.col("captions") > 1, "more than one caption"), F.when(wrong_end, "caption in the middle"),
        F.when(table & (F.col("heads") > 1), "more than one head"), F.when(table & (F.col("feet") > 1), "more than one foot"),
        F.when(table & (F.col("heads") + F.col("feet") > 0) & (F.col("bodies") == 0), "head or foot without a body")))
    limits = rule_of(held.select("doc_id", "id", "_ptype", F.explode(problems).alias("problem")), "_ptype")
    return (
        misplaced.select("doc_id", "id", "rule", F.lit("in the wrong place").alias("problem"))
        .unionByName(foreign.select("doc_id", "id", "rule", F.lit("holds other elements").alias("problem")))
        .unionByName(limits.select("doc_id", "id", "rule", "problem")))


def resolve_aliases(aliases: DataFrame, used: DataFrame, limit: int | None = None) -> DataFrame:
    """What type aliases `(doc_id, type, target)` lead to, for the types `used (doc_id, type)` and the map itself.

    status: standard, mapped, remapped (02-004: a standard type mapped away), circular (02-003) or unmapped (02-001).
    """
    standard = F.col("type").isin(*STANDARD_TYPES)
    remapped = aliases.where(standard).select("doc_id", "type", F.lit(None).cast("string").alias("resolved"), F.lit("02-004").alias("status"))
    own = aliases.where(~standard)
    known = own.select("doc_id", F.col("type").alias("target"), F.lit(True).alias("_on"))
    links = own.join(known, ["doc_id", "target"], "left").select(
        "doc_id", F.col("type").alias("node"), F.col("target").alias("parent"), F.col("_on").isNull().alias("parent_ends"))
    ends = closure.chain_ends(links, ["doc_id"], limit).select("doc_id", F.col("node").alias("type"), "root")
    reached = own.select("doc_id", "type").join(ends, ["doc_id", "type"], "left")
    good = F.col("root").isin(*STANDARD_TYPES)
    mapped = reached.select("doc_id", "type", F.when(good, F.col("root")).alias("resolved"),
                            F.when(F.col("root").isNull(), "02-003").when(good, "mapped").otherwise("02-001").alias("status"))
    alone = used.distinct().join(own.select("doc_id", "type"), ["doc_id", "type"], "left_anti").select(
        "doc_id", "type", F.when(standard, F.col("type")).alias("resolved"), F.when(standard, "standard").otherwise("02-001").alias("status"))
    return mapped.unionByName(remapped).unionByName(alone)
