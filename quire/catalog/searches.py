"""Search (C) over the pages of the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import derived
from quire.catalog.base import query, table
from quire.functions import patterns
from quire.operators import search

PHRASE = "the of"


def _hits_sql(pattern: str, name: str = "hits", phrase: str = PHRASE) -> str:
    """The hits of a pattern in SQL: pieces between hits, then running lengths."""
    p = pattern.replace("'", "''")
    return rf"""
{name}_parts AS (
  SELECT doc_id, lang, source, page_no, text, unnest(eaten) AS eaten, unnest(found) AS found, unnest(gaps[1:len(eaten)]) AS gap, unnest(range(len(eaten))) AS ord
  FROM (SELECT *, regexp_extract_all(text, '{p}') AS eaten, regexp_extract_all(text, '{p}', 1) AS found, string_split_regex(text, '{p}') AS gaps FROM page_texts)
),
{name} AS (
  SELECT doc_id, lang, source, page_no, '{phrase}' AS query, start, length(found) AS length,
         translate(substring(text, greatest(start - 30, 0) + 1, length(found) + 60), chr(13) || chr(10), '  ') AS snippet
  FROM (SELECT *, (sum(length(gap) + length(eaten)) OVER (PARTITION BY doc_id, page_no ORDER BY ord) - length(eaten))::BIGINT AS start FROM {name}_parts)
  WHERE found <> ''
)"""


HITS = derived.PAGE_TEXTS + "," + _hits_sql(patterns.search_pattern(PHRASE))


def hits(spark, folder, *keep, **options):
    return search.find(derived.page_texts(spark, folder, *keep), PHRASE, **options)


@query("C1_find_phrase", f"""
WITH {HITS} SELECT doc_id, page_no::BIGINT AS page_no, query, start, length::BIGINT AS length, snippet FROM hits
""")
def find(spark, folder):
    return hits(spark, folder)


@query("C1_find_match_case", f"""
WITH {derived.PAGE_TEXTS}, {_hits_sql(patterns.search_pattern(PHRASE, match_case=True))}
SELECT doc_id, page_no::BIGINT AS page_no, query, start, length::BIGINT AS length, snippet FROM hits
""")
def find_match_case(spark, folder):
    return hits(spark, folder, match_case=True)


@query("C1_find_overlapping", f"""
WITH {derived.PAGE_TEXTS},
places AS (SELECT doc_id, page_no, text, unnest(range(length(text) - 3)) AS start FROM page_texts)
SELECT doc_id, page_no::BIGINT AS page_no, 'anan' AS query, start, 4::BIGINT AS length,
       translate(substring(text, greatest(start - 30, 0) + 1, 64), chr(13) || chr(10), '  ') AS snippet
FROM places WHERE lower(substring(text, start + 1, 4)) = 'anan'
""")
def find_overlapping(spark, folder):
    return search.find(derived.page_texts(spark, folder), "anan", consecutive=True)


@query("C2_match_counts", f"""
WITH {HITS}
SELECT source, lang, count(*) AS hits, count(DISTINCT (doc_id, page_no)) AS pages, count(DISTINCT doc_id) AS documents
FROM hits GROUP BY source, lang
""")
def match_counts(spark, folder):
    return search.match_stats(hits(spark, folder, "source", "lang"), ["source", "lang"])


@query("C2_match_numbers", f"""
WITH {HITS}
SELECT query, doc_id, page_no::BIGINT AS page_no, start, length::BIGINT AS length, snippet,
       row_number() OVER (PARTITION BY query, doc_id ORDER BY page_no, start) AS k, count(*) OVER (PARTITION BY query, doc_id) AS n
FROM hits
""")
def match_numbers(spark, folder):
    return search.number_matches(hits(spark, folder))


@query("C3_whole_word", rf"""
WITH {derived.PAGE_TEXTS}, padded AS (SELECT doc_id, page_no, ' ' || text || ' ' AS text FROM page_texts),
parts AS (
  SELECT doc_id, page_no, text, unnest(string_split_regex(text, '[aA][nN]')) AS gap, unnest(range(len(string_split_regex(text, '[aA][nN]')))) AS ord FROM padded),
places AS (
  SELECT doc_id, page_no, text, (sum(length(gap) + 2) OVER (PARTITION BY doc_id, page_no ORDER BY ord) - 2)::BIGINT AS p,
         lead(1) OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS more
  FROM parts)
SELECT doc_id, page_no::BIGINT AS page_no, 'an' AS query, p - 1 AS start, 2::BIGINT AS length,
       translate(substring(substring(text, 2, length(text) - 2), greatest(p - 31, 0) + 1, 62), chr(13) || chr(10), '  ') AS snippet
FROM places WHERE more IS NOT NULL
  AND NOT regexp_matches(substring(text, p, 1), '[0-9A-Z\[\\\]^_`a-z]') AND NOT regexp_matches(substring(text, p + 3, 1), '[0-9A-Z\[\\\]^_`a-z]')
""")
def whole_word(spark, folder):
    return search.find(derived.page_texts(spark, folder), "an", whole_word=True)


@query("C4_first_hits", f"""
WITH {HITS}
SELECT doc_id, page_no::BIGINT AS page_no, query, start, length::BIGINT AS length, snippet
FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc_id, page_no, start) <= 1000
""")
def first_hits(spark, folder):
    return search.limit_hits(hits(spark, folder), 1000)


@query("C5_find_many", rf"""
WITH {derived.PAGE_TEXTS},
q AS (SELECT item_id, text AS query, '(?i)' || regexp_replace(regexp_escape(text), '(\\ | )+', '[ ' || chr(10) || chr(13) || chr(160) || ']+', 'g') AS re FROM benchmark),
found AS (
  SELECT doc_id, page_no, item_id, p.text, unnest(regexp_extract_all(p.text, re)) AS hit,
         unnest(string_split_regex(p.text, re)[1:len(regexp_extract_all(p.text, re))]) AS gap, unnest(range(len(regexp_extract_all(p.text, re)))) AS ord
  FROM page_texts p JOIN q ON regexp_matches(p.text, re))
SELECT item_id AS query_id, doc_id, page_no::BIGINT AS page_no,
       (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, page_no, item_id ORDER BY ord) - length(hit))::BIGINT AS start, length(hit)::BIGINT AS length
FROM found
""")
def find_many(spark, folder):
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = search.find_all(queries, derived.page_texts(spark, folder))
    return found.select("query_id", "doc_id", "page_no", "start", "length")


@query("C6_redact_hits", f"""
WITH {derived.PAGE_TEXTS},
r AS (SELECT doc_id, page_no, regexp_extract_all(text, '[tT][hH][aA][tT]') AS hits, text FROM page_texts)
SELECT doc_id, page_no::BIGINT AS page_no, regexp_replace(text, '[tT][hH][aA][tT]', '████', 'g') AS text, len(hits)::BIGINT AS marks, (4 * len(hits))::BIGINT AS removed
FROM r
""")
def redact(spark, folder):
    return search.redact_hits(derived.page_texts(spark, folder), "that")
