"""Positioned tables derived from the given ones, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog.base import table
from quire.operators import units
from quire.sources import documents as D

PER_PAGE = 40


def lines(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    rows = D.lines(table(spark, folder, "documents").select("doc_id", "text", *keep), PER_PAGE)
    first = F.col("line_no") == 0
    return rows.select(
        "doc_id", *keep, "page_no", "line_no", "text",
        (72 + 18 * (F.col("doc_id") % 3)).cast("double").alias("x"),
        (F.col("line_no") * 18).cast("double").alias("y"),
        F.least(F.length("text") * 6, F.lit(460)).cast("double").alias("w"),
        F.lit(12.0).alias("h"),
        F.when((F.length("text") <= 40) & first, 16.0).otherwise(11.0).alias("size"),
        first.alias("bold"),
    )


LINES = """
raw_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
),
lines AS (
  SELECT doc_id, lang, source, pos // 40 + 1 AS page_no, pos % 40 AS line_no, text,
         (72 + 18 * (doc_id % 3))::DOUBLE AS x, ((pos % 40) * 18)::DOUBLE AS y,
         least(length(text) * 6, 460)::DOUBLE AS w, 12.0::DOUBLE AS h,
         CASE WHEN length(text) <= 40 AND pos % 40 = 0 THEN 16.0 ELSE 11.0 END::DOUBLE AS size,
         pos % 40 = 0 AS bold
  FROM raw_lines
)"""


def page_texts(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return D.page_texts(table(spark, folder, "documents").select("doc_id", "text", *keep), PER_PAGE)


PAGE_TEXTS = """
page_texts AS (
  SELECT doc_id, lang, source, i + 1 AS page_no, array_to_string(ls[i * 40 + 1 : i * 40 + 40], chr(10)) AS text
  FROM (SELECT doc_id, lang, source, ls, unnest(range((len(ls) - 1) // 40 + 1)) AS i
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents))
)"""


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the documents with a made-up size and rotation, without reading their lines."""
    base = page_texts(spark, folder).select("doc_id", "page_no")
    return base.select(
        "doc_id", "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
        (90 * ((F.col("doc_id") + F.col("page_no")) % 4)).cast("int").alias("rotation"),
    )


PAGES = PAGE_TEXTS + """,
doc_pages AS (
  SELECT doc_id, page_no, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 90 * ((doc_id + page_no) % 4) AS rotation
  FROM page_texts
)"""


def words(spark: SparkSession, folder: str) -> DataFrame:
    return words_of(lines(spark, folder))


def words_of(lines_: DataFrame, *keep: str) -> DataFrame:
    """The words of lines, set in characters six points wide."""
    found = units.words(lines_.select("doc_id", "page_no", "line_no", "text", "x", "y", "h", *keep))
    return found.select(
        "doc_id", "page_no", "line_no", "start", "length", "word",
        (F.col("x") + 6 * F.col("start")).alias("x"), "y", (6.0 * F.col("length")).alias("w"), "h", *keep,
    )


WORDS = LINES + r""",
word_parts AS (
  SELECT doc_id, page_no, line_no, x, y, h, unnest(hits) AS word, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS ord
  FROM (SELECT *, regexp_extract_all(text, '[^\p{Z}\p{Cc}]+') AS hits, string_split_regex(text, '[^\p{Z}\p{Cc}]+') AS gaps FROM lines)
),
words AS (
  SELECT doc_id, page_no, line_no, ord, s AS start, length(word) AS length, word, x + 6 * s AS x, y, 6.0 * length(word)::DOUBLE AS w, h
  FROM (SELECT *, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY ord) - length(word))::BIGINT AS s
        FROM word_parts)
)"""


def page_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents' pages, and a later version with some pages changed, dropped and added."""
    before = page_texts(spark, folder)
    at = F.col("doc_id") + F.col("page_no")
    kept = before.where(at % 11 != 0).withColumn("text", F.when(at % 7 == 0, F.upper("text")).otherwise(F.col("text")))
    added = (
        table(spark, folder, "documents").where(F.col("doc_id") % 13 == 0)
        .select("doc_id", (F.floor(F.size(F.split("text", "\n", -1)) / PER_PAGE) + 900).cast("int").alias("page_no"), F.lit("added page").alias("text"))
    )
    return before, kept.unionByName(added)


PAGE_VERSIONS = PAGE_TEXTS + """,
docs_v2 AS (
  SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 7 = 0 THEN upper(text) ELSE text END AS text
  FROM page_texts WHERE (doc_id + page_no) % 11 <> 0
  UNION ALL
  SELECT doc_id, len(string_split(text, chr(10))) // 40 + 900, 'added page' FROM documents WHERE doc_id % 13 = 0
)"""
