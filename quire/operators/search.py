"""Phrase search over pages or lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import arrays, patterns
from quire.plans import blocks, sizes

SNIPPET = 30


def _matches(df: DataFrame, pattern: Column, overlapping: bool) -> DataFrame:
    """Rows of `df` exploded to its hits; `pattern` holds the hit in group 1."""
    kept = df.columns
    # A mark before the text keeps a zero-width match at the very start from being dropped by split.
    body = F.concat(F.lit("\u0001"), "text") if overlapping else F.col("text")
    shift = 1 if overlapping else 0
    found = df.where(F.regexp_like("text", pattern)).select(
        *kept,
        F.regexp_extract_all(body, pattern, F.lit(1)).alias("_hits"),
        (F.array() if overlapping else F.regexp_extract_all(body, pattern, F.lit(0))).cast("array<string>").alias("_eaten"),
        F.split(body, pattern, -1).alias("_gaps"),
    )
    found = found.withColumn("_gap", F.transform(F.expr("slice(_gaps, 1, size(_hits))"), lambda g: F.length(g)))
    step = F.col("_gap") if overlapping else F.zip_with("_gap", "_eaten", lambda g, h: g + F.length(h))
    found = found.withColumn("_step", step)
    starts = F.zip_with(arrays.exclusive_prefix(F.col("_step")), "_gap", lambda p, g: p + g - shift)
    found = found.withColumn("_start", starts)
    rows = found.select(*kept, F.explode(F.arrays_zip("_start", "_hits")).alias("_hit")).where("_hit._hits <> ''")
    rows = rows.select(*kept, F.col("_hit._start").alias("start"), F.length("_hit._hits").alias("length"))
    begin = F.greatest(F.col("start") - SNIPPET, F.lit(0))
    snippet = F.substring(F.col("text"), begin + 1, F.col("length") + 2 * SNIPPET)
    return rows.withColumn("snippet", F.translate(snippet, "\r\n", "  ")).drop("text")


def find(texts: DataFrame, query: str, match_case: bool = False, whole_word: bool = False, consecutive: bool = False) -> DataFrame:
    """Every occurrence of a phrase: 0-based start, length and a one-line snippet."""
    pattern = patterns.search_pattern(query, match_case, whole_word, consecutive)
    return _matches(texts, F.lit(pattern), consecutive).withColumn("query", F.lit(query))


def match_stats(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits, pages and documents with hits for each key."""
    per_page = hits.groupBy(*dict.fromkeys([*keys, "doc_id", "page_no"])).agg(F.count(F.lit(1)).alias("_n"))
    per_doc = per_page.groupBy(*dict.fromkeys([*keys, "doc_id"])).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_p"))
    return per_doc.groupBy(*keys).agg(
        F.sum("_n").alias("hits"), F.sum("_p").alias("pages"), F.count(F.lit(1)).alias("documents")
    )


def number_matches(hits: DataFrame, pages_per_block: int = 64) -> DataFrame:
    """Each hit as "match k of n" within its query and document."""
    cut = blocks.by_value(hits, "page_no", pages_per_block)
    numbered = blocks.scan(cut, ["query", "doc_id"], ["page_no", "start"], k=("number", None))
    totals = hits.groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return numbered.join(totals, ["query", "doc_id"])


def limit_hits(hits: DataFrame, max_results: int = 1000) -> DataFrame:
    """The first hits of each query in document, page and text order."""
    order = W.partitionBy("query").orderBy("doc_id", "page_no", "start")
    return hits.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= max_results).drop("_rn")


ANCHOR_WORDS = 3


def _anchor(query: str) -> tuple[int, str]:
    """What every page with a hit must contain: (k, run of k whole tokens), or (-k, k characters of a token)."""
    pieces = [p for w in patterns.query_words(query) for p in re.split("[ \n\r\u00a0]+", w.lower().replace("ς", "σ")) if p]
    inner = pieces[1:-1]
    if inner and not any(patterns.stands_alone(ch) for p in pieces for ch in p):
        size = min(len(inner), ANCHOR_WORDS)
        return size, max((" ".join(inner[i:i + size]) for i in range(len(inner) - size + 1)), key=len)
    if not pieces:
        return 0, ""
    longest = max(pieces, key=len)
    size = min(len(longest), 3)
    return -size, longest[:size]


_COMPILED = T.StructType().add("pattern", "string").add("kind", "integer").add("key", "string")


@F.pandas_udf(_COMPILED)
def _compiled(queries: pd.Series) -> pd.DataFrame:
    made = [(patterns.search_pattern(q), *_anchor(q)) for q in queries]
    return pd.DataFrame(made, columns=["pattern", "kind", "key"])


def _page_anchors(kind: int) -> Column:
    """The hashes of every anchor of one kind in a page's `_tokens`."""
    size = abs(kind)
    tag = lambda key: F.xxhash64(F.lit(kind), key)
    if kind == 0:
        return F.array(tag(F.lit("")))
    if kind > 0:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_tokens") - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: tag(F.array_join(F.slice("_tokens", i, size), " ")))

    def pieces(token: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(token) - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(token, i, F.lit(size)))

    every = F.array_distinct(F.flatten(F.transform(F.array_distinct("_tokens"), pieces)))
    return F.transform(every, tag)


def find_all(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """The search for a whole table of queries `(query_id, query)` over pages `(doc_id, page_no, text)`.

    A query's inner words stand between spaces, so they are whole tokens of every page with a hit: pages
    and queries meet on one hashed run of inner words. Shorter queries meet on a run of up to three
    characters of one word. The pattern then decides.
    """
    keyed = (
        queries.where("query <> ''").withColumn("_c", _compiled("query"))
        .select("query_id", "query", "_c.pattern", "_c.kind", F.xxhash64("_c.kind", "_c.key").alias("anchor"))
    )
    kinds = [r[0] for r in keyed.select("kind").distinct().collect()]  # at most seven values

    tokens = F.split(F.translate(F.lower("text"), "ς", "σ"), f"{patterns.GAP}+", -1)
    found = F.array_distinct(F.flatten(F.array(*[_page_anchors(kind) for kind in kinds])))
    anchors = (
        pages.withColumn("_tokens", tokens)
        .select("doc_id", "page_no", F.explode(found).alias("anchor"))
    )
    candidates = anchors.join(sizes.small(keyed.drop("kind")), "anchor").drop("anchor")
    texts = candidates.join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"])
    columns = ["doc_id", "page_no", "query_id", "query", "pattern", "text"]
    return _matches(texts.select(*columns), F.col("pattern"), False).drop("pattern")


def redact_hits(texts: DataFrame, query: str, fill: str = "█", **options: bool) -> DataFrame:
    """Every hit masked character by character, with the number of hits and of characters removed."""
    pattern = patterns.search_pattern(query, **options)
    hits = F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda h: h != "")
    staged = texts.withColumn("_hits", hits)
    # Hits are cut out and put back as fill of the same length; the rest of the text is untouched.
    staged = staged.withColumn("_eaten", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    staged = staged.withColumn("_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
    masked = F.zip_with("_eaten", "_found", lambda e, f: F.when(f == "", e).otherwise(F.repeat(F.lit(fill), F.length(f))))
    gaps = F.split("text", pattern, -1)
    text = F.array_join(F.flatten(F.zip_with(gaps, masked, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    return staged.select(
        *[c for c in texts.columns if c != "text"],
        F.when(F.size("_eaten") > 0, text).otherwise(F.col("text")).alias("text"),
        F.size("_hits").cast("long").alias("marks"),
        arrays.total(F.transform("_hits", lambda h: F.length(h))).cast("long").alias("removed"),
    )
