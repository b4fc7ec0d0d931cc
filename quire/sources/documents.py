"""Documents, pages and lines from files or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: the printable characters of code page 1252 at 0x80-0x9F (the rest stay as they are)
CP1252_FROM = "".join(map(chr, (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F)))
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹Œ" + "Ž" + "‘’“”•–—˜™š›œ" + "žŸ"
# ------------------------------------------------------------------------------------------------


def manifest(spark: SparkSession, path_glob: str) -> DataFrame:
    """One row per file: path, fingerprint, size and the version named in its header."""
    files = spark.read.format("binaryFile").load(path_glob)
    head = F.decode(F.substring("content", 1, 16), "iso-8859-1")
    return files.select(
        "path",
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
        F.coalesce(F.nullif(F.regexp_extract(head, r"%PDF-(.{3})", 1), F.lit("")), F.lit("1.7")).alias("header_version"),
    )


def text_manifest(documents: DataFrame) -> DataFrame:
    """The manifest of documents that are already rows of text."""
    return documents.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.char_length("text").cast("long").alias("n_chars"),
    )


def _mark(content: Column) -> Column:
    start = F.hex(F.substring(content, 1, 4))
    return (
        F.when(start.startswith("EFBBBF"), "utf-8-bom")
        .when(start == "FFFE0000", "utf-32le")
        .when(start.startswith("FFFE"), "utf-16le")
        .when(start.startswith("FEFF"), "utf-16be")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .otherwise("windows-1252")
    )


def text_intake(spark: SparkSession, path_glob: str) -> tuple[DataFrame, DataFrame]:
    """Text files as documents, decoded by their byte-order mark, as UTF-8 when valid, else as a single-byte text.

    Returns the documents and how many documents and bytes there are per encoding.
    """
    files = spark.read.format("binaryFile").load(path_glob).withColumn("encoding", _mark(F.col("content")))
    body = F.col("content")
    single = F.translate(F.decode(body, "iso-8859-1"), CP1252_FROM, CP1252_TO)
    text = (
        F.when(F.col("encoding") == "utf-8-bom", F.decode(F.expr("substring(content, 4)"), "utf-8"))
        .when(F.col("encoding") == "utf-32le", F.decode(F.expr("substring(content, 5)"), "utf-32le"))
        .when(F.col("encoding") == "utf-16le", F.decode(F.expr("substring(content, 3)"), "utf-16le"))
        .when(F.col("encoding") == "utf-16be", F.decode(F.expr("substring(content, 3)"), "utf-16be"))
        .when(F.col("encoding") == "utf-8", F.col("content").cast("string"))
        .otherwise(single)
    )
    documents = files.select("path", "encoding", F.col("length").alias("bytes"), text.alias("text"))
    counts = documents.groupBy("encoding").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"))
    return documents, counts


def lines(documents: DataFrame, per_page: int = 40, form_feed: bool = False) -> DataFrame:
    """Every line of every document with its page and its place on the page.

    A page takes `per_page` lines; with `form_feed` a form feed also starts a page, and the lines after it
    are counted from there. The other columns of `documents` are kept.
    """
    kept = [c for c in documents.columns if c != "text"]
    size = F.lit(per_page)
    if not form_feed:
        rows = documents.select(*kept, F.posexplode(F.split("text", "\n", -1)).alias("_pos", "text"))
        return rows.select(
            *kept,
            (F.floor(F.col("_pos") / size) + 1).cast("int").alias("page_no"),
            F.pmod("_pos", size).cast("int").alias("line_no"),
            "text",
        )
    # Pages before a section: the page counts of the sections before it, summed inside the row.
    sections = F.transform(F.split("text", "\f", -1), lambda s: F.split(s, "\n", -1))
    staged = documents.withColumn("_sections", sections)
    pages = F.transform("_sections", lambda s: F.ceil(F.size(s) / size).cast("int"))
    staged = staged.withColumn("_pages", pages)
    placed = staged.select(*kept, "_pages", F.posexplode("_sections").alias("_section", "_lines"))
    before = F.aggregate(F.expr("slice(_pages, 1, _section)"), F.lit(0), lambda a, x: a + x)
    rows = placed.select(*kept, before.alias("_before"), F.posexplode("_lines").alias("_pos", "text"))
    return rows.select(
        *kept,
        (F.col("_before") + F.floor(F.col("_pos") / size) + 1).cast("int").alias("page_no"),
        F.pmod("_pos", size).cast("int").alias("line_no"),
        "text",
    )


def page_texts(documents: DataFrame, per_page: int = 40) -> DataFrame:
    """The documents' pages, each with its lines joined by line breaks."""
    kept = [c for c in documents.columns if c != "text"]
    staged = documents.withColumn("_lines", F.split("text", "\n", -1))
    starts = F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / per_page).cast("int"))
    texts = F.transform(starts, lambda i: F.array_join(F.slice("_lines", i * per_page + 1, per_page), "\n"))
    rows = staged.select(*kept, F.posexplode(texts).alias("_page", "text"))
    return rows.select(*kept, (F.col("_page") + 1).alias("page_no"), "text")


def page_catalog(pages: DataFrame) -> DataFrame:
    """One row per page with the size it is shown at, its rotation and its aspect ratio."""
    turned = F.pmod("rotation", F.lit(360)).isin(90, 270)
    shown = pages.withColumns({
        "shown_width": F.when(turned, F.col("height")).otherwise(F.col("width")),
        "shown_height": F.when(turned, F.col("width")).otherwise(F.col("height")),
    })
    ratio = F.when(F.col("shown_height") > 0, F.col("shown_width") / F.col("shown_height")).otherwise(F.lit(1.0))
    return shown.select("doc_id", "page_no", "shown_width", "shown_height", "rotation", ratio.alias("aspect"))


def pages_without_text(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Pages without any word: the ones to send to text recognition."""
    return pages.join(words.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")


def corpus_profile(documents: DataFrame, tags: dict[str, Column], pages: Column | None = None, bytes_: Column | None = None) -> DataFrame:
    """Documents, pages and bytes per value of every tag."""
    entries = F.array(*[F.struct(F.lit(k).alias("tag"), v.cast("string").alias("value")) for k, v in tags.items()])
    rows = documents.select(
        (F.lit(1) if pages is None else pages).cast("long").alias("_pages"),
        (F.lit(0) if bytes_ is None else bytes_).cast("long").alias("_bytes"),
        F.explode(entries).alias("_entry"),
    )
    return rows.groupBy("_entry.tag", "_entry.value").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("_pages").alias("pages"), F.sum("_bytes").alias("bytes")
    )


def property_counts(documents: DataFrame, custom: str = "custom") -> DataFrame:
    """How many documents carry each custom property."""
    return documents.select(F.explode(F.map_keys(custom)).alias("property")).groupBy("property").agg(
        F.count(F.lit(1)).alias("documents")
    )
