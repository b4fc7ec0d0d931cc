"""Comments and field values from and to XFDF documents, and reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans import blocks

# ---- fixed values --------------------------------------------------------------------------------
NAMESPACE = "http://ns.adobe.com/xfdf/"
SUBTYPES = {
    "highlight": "Highlight", "underline": "Underline", "strikeout": "StrikeOut", "squiggly": "Squiggly", "text": "Text", "freetext": "FreeText",
    "ink": "Ink", "square": "Square", "circle": "Circle", "line": "Line", "polygon": "Polygon", "polyline": "PolyLine", "stamp": "Stamp",
}
MAX_ANNOTATIONS = 10_000
FIELD_DEPTH = 16
ATTRIBUTES = ("page", "rect", "color", "title", "subject", "name", "date", "creationdate", "flags", "coords", "inreplyto", "replyType", "state", "statemodel")
# --------------------------------------------------------------------------------------------------

_ANNOTATION = T.StructType([T.StructField("_" + a, T.StringType()) for a in ATTRIBUTES] + [
    T.StructField("contents", T.StringType()), T.StructField("vertices", T.StringType())])
_ANNOTS = T.StructType([T.StructField(e, T.ArrayType(_ANNOTATION)) for e in SUBTYPES])


def _xml(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.format("xml").options(rowTag=tag, mode="PERMISSIVE", ignoreNamespace="true").schema(schema).load(path)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """The annotations of XFDF files, one row each; those without a readable page or rectangle are left out.

    All subtypes come from one read of the files.
    """
    rows = _xml(spark, path, "annots", _ANNOTS)
    tagged = F.array(*[F.struct(F.lit(SUBTYPES[e]).alias("subtype"), F.coalesce(e, F.array().cast(T.ArrayType(_ANNOTATION))).alias("items")) for e in SUBTYPES])
    each = rows.select("path", F.explode(tagged).alias("_t")).select("path", "_t.subtype", F.posexplode("_t.items").alias("ord", "_a"))
    numbers = lambda c: F.transform(F.split(c, r"\s*,\s*"), lambda v: v.try_cast("double"))
    read = each.select(
        "path", "subtype", "ord", (F.col("_a._page").try_cast("int") + 1).alias("page_no"), numbers(F.col("_a._rect")).alias("rect"),
        F.col("_a._title").alias("author"), F.col("_a._subject").alias("subject"), F.col("_a._name").alias("name"), F.col("_a._date").alias("modified"),
        F.col("_a._creationdate").alias("created"), F.col("_a._flags").alias("flags"), F.col("_a._color").alias("color"), numbers(F.col("_a._coords")).alias("coords"),
        F.col("_a._inreplyto").alias("reply_to"), F.when(F.col("_a._replyType") == "group", "Group").otherwise("R").alias("reply_type"),
        F.col("_a._state").alias("state"), F.col("_a._statemodel").alias("state_model"), F.coalesce("_a.contents", F.lit("")).alias("contents"))
    good = (F.size("rect") == 4) & F.forall("rect", lambda v: v.isNotNull())
    return read.where((F.col("page_no") >= 1) & good)


def _field_type(depth: int) -> T.StructType:
    fields = [T.StructField("_name", T.StringType()), T.StructField("value", T.ArrayType(T.StringType()))]
    if depth > 1:
        fields.append(T.StructField("field", T.ArrayType(_field_type(depth - 1))))
    return T.StructType(fields)


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """The field values of XFDF files `(path, name, values)`; nested fields build dotted names."""
    schema = T.StructType([T.StructField("field", T.ArrayType(_field_type(FIELD_DEPTH)))])
    level = _xml(spark, path, "fields", schema).select("path", F.lit("").alias("prefix"), F.explode("field").alias("_f"))
    named = lambda df: df.where("_f._name <> ''").select(
        "path", F.when(F.col("prefix") == "", F.col("_f._name")).otherwise(F.concat_ws(".", "prefix", "_f._name")).alias("name"), "_f")
    found: DataFrame | None = None
    for depth in range(FIELD_DEPTH, 0, -1):
        here = named(level)
        values = here.where("size(_f.value) > 0").select("path", "name", F.col("_f.value").alias("values"))
        found = values if found is None else found.unionByName(values)
        if depth > 1:
            level = here.select("path", F.col("name").alias("prefix"), F.explode("_f.field").alias("_f"))
    return found


def _escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def _attribute(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f' {name}="'), _escaped(value.cast("string")), F.lit('"'))).otherwise("")


def _documents(rows: DataFrame, element: Column, wrapper: str) -> DataFrame:
    """XFDF texts of at most MAX_ANNOTATIONS elements; a document with more gets several."""
    numbered = blocks.scan(blocks.by_value(rows.withColumn("_e", element), "ord", 65536), ["doc_id"], ["ord"], _n=("number", None))
    parts = numbered.withColumn("part", F.floor((F.col("_n") - 1) / MAX_ANNOTATIONS) + 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_e"))), lambda s: s["_e"]), "")
    head = f'<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="{NAMESPACE}" xml:space="preserve"><{wrapper}>'
    return parts.groupBy("doc_id", "part").agg(body.alias("_b")).select("doc_id", "part", F.concat(F.lit(head), "_b", F.lit(f"</{wrapper}></xfdf>")).alias("xml"))


def comments_as_xfdf(comments: DataFrame) -> DataFrame:
    """Comments `(doc_id, ord, subtype, page_no, rect, author, name, created, reply_to, state, state_model, contents)` as XFDF texts."""
    tag = F.lit(None).cast("string")
    for element, subtype in SUBTYPES.items():
        tag = F.when(F.col("subtype") == subtype, element).otherwise(tag)
    rows = comments.withColumn("_tag", tag).where("_tag is not null")
    rect = F.array_join(F.transform("rect", lambda v: v.cast("string")), ",")
    status = (F.coalesce("state", F.lit("")) != "") & (F.coalesce("reply_to", F.lit("")) != "")
    element = F.concat(
        F.lit("<"), "_tag", _attribute("page", F.col("page_no") - 1), _attribute("rect", rect), _attribute("title", F.col("author")), _attribute("name", F.col("name")),
        _attribute("creationdate", F.col("created")), _attribute("inreplyto", F.col("reply_to")),
        F.when(status, F.concat(_attribute("state", F.col("state")), _attribute("statemodel", F.col("state_model")))).otherwise(""),
        F.lit("><contents>"), _escaped(F.col("contents")), F.lit("</contents></"), "_tag", F.lit(">"))
    return _documents(rows, element, "annots")


def fields_as_xfdf(fields: DataFrame) -> DataFrame:
    """Field values `(doc_id, ord, name, value)` as XFDF texts, by dotted name."""
    element = F.concat(F.lit('<field name="'), _escaped(F.col("name")), F.lit('"><value>'), _escaped(F.col("value")), F.lit("</value></field>"))
    return _documents(fields, element, "fields")


def write_texts(documents: DataFrame, path: str) -> None:
    """XFDF texts written as files, spread by document."""
    documents.select("doc_id", F.col("xml").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines."""
    findings.write.mode("overwrite").json(path)
