"""Benchmark decontamination over a positional inverted index.

Every benchmark item is cut into windows of consecutive words. The index holds postings (word, key, position) of the
training texts for the words that occur in the benchmark, and a posting of the empty word at each text's end, which
gives its length. A window is looked up from its rarest word: the places where it would begin are intersected with
those of its next rarest words, exactly for phrases and within a distance for near matches. What is left is compared
with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rarest words of a window whose postings are intersected before the text is looked at.
RAREST = 3


def words(text: Column) -> Column:
    """Words of digits, ASCII letters and everything beyond ASCII, with A-Z in lower case; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), lambda w: w != "")


def phrases(items: DataFrame, size: int = 10) -> DataFrame:
    """`(item_id, phrase, words)`: every distinct run of `size` words of an item, or the whole of a shorter one. Items
    without id or words have none."""
    tokens = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    runs = tokens.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, F.lit(size)))).alias("words"))
    return runs.select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def build(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index of `(doc_id, text)` over the words of `vocabulary (word)`: `(word, key, doc_id, position)`, staged.

    Whether the vocabulary is broadcast is left to its size as written.
    """
    rows = common.texts(docs).select("doc_id", common.row_key().alias("key"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    every = rows.select("doc_id", "key", F.posexplode("w").alias("position", "word"))
    return common.staged(every.join(vocabulary, "word").select("word", "key", "doc_id", "position"), "index")


def anchors(runs: DataFrame, index: DataFrame, rarest: int = RAREST) -> DataFrame:
    """`(phrase, length, word, offset, rank)`: the rarest words of each phrase, rank 1 being the rarest of all. Phrases with
    a word that no text has cannot occur and are left out."""
    counts = index.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = runs.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word")).distinct()
    met = each.join(counts, "word")
    group = W.partitionBy("phrase")  # a phrase has few words
    ranked = met.withColumn("known", F.count(F.lit(1)).over(group)).withColumn("rank", F.row_number().over(group.orderBy("n", "word", "offset")))
    return ranked.where(f"known = length and rank <= {rarest}").select("phrase", "length", "word", "offset", "rank")


def begin(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where each phrase would begin by its rarest word: `(phrase, key, start)`."""
    first = wanted.where("rank = 1").select("phrase", "word", "offset")
    return index.join(first, "word").select("phrase", "key", (F.col("position") - F.col("offset")).alias("start")).where("start >= 0").distinct()


def intersected(found: DataFrame, index: DataFrame, wanted: DataFrame, distance: int = 0, rarest: int = RAREST) -> DataFrame:
    """Those of `found (phrase, key, start)` of which each further word stands where it should, or at most `distance` away.

    Places meet on squares of `distance + 1` positions and their neighbours, so no text's places are paired with each other.
    """
    step = distance + 1
    places = index.withColumnRenamed("position", "at").withColumn("square", F.floor(F.col("at") / step))
    for rank in range(2, rarest + 1):
        more = wanted.where(F.col("rank") == rank).select("phrase", "word", "offset")
        asked = found.join(more, "phrase", "left").withColumn("due", F.col("start") + F.col("offset"))
        done = asked.where("word is null").select("phrase", "key", "start")
        near = F.array(*[F.floor(F.col("due") / step) + k for k in ((-1, 0, 1) if distance else (0,))])
        open_ = asked.where("word is not null").select("phrase", "key", "start", "word", "due", F.explode(near).alias("square"))
        met = open_.join(places.select("word", "key", "at", "square"), ["word", "key", "square"]).where(F.abs(F.col("at") - F.col("due")) <= distance)
        found = met.select("phrase", "key", "start").distinct().unionByName(done)
    return found


def verified(found: DataFrame, runs: DataFrame, docs: DataFrame) -> DataFrame:
    """`(phrase, key, start, length)` where the text really has the phrase's words from there on."""
    per_row = found.join(runs.select("phrase", "words").distinct(), "phrase").groupBy("key").agg(F.collect_list(F.struct("phrase", "words", "start")).alias("asked"))
    asked = common.staged(per_row, "asked")
    rows = common.texts(docs).select(common.row_key().alias("key"), "text").join(asked, "key").select("key", "asked", words(F.col("text")).alias("w"))
    good = F.filter("asked", lambda a: F.slice("w", a["start"] + 1, F.size(a["words"])) == a["words"])
    hits = rows.select("key", F.explode(good).alias("a"))
    return hits.select("a.phrase", "key", "a.start", F.size("a.words").alias("length")).distinct()


def matched(docs: DataFrame, items: DataFrame, size: int = 10, distance: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, exact, near): `(doc_id, key, n_words)` for every row; the phrases it has, `(key, phrase, start, length)`; and
    those whose rarest words stand within `distance` of their places, `(key, phrase, start)`."""
    runs = common.staged(phrases(items, size), "phrases")
    vocabulary = runs.select(F.explode("words").alias("word")).union(runs.sparkSession.createDataFrame([("",)], "word string")).distinct()
    index = build(docs, common.staged(vocabulary, "vocabulary"))
    wanted = common.staged(anchors(runs, index), "anchors")
    # Only the postings of words that are looked up are shuffled by what follows.
    asked = common.staged(wanted.select("word").distinct(), "asked-words")
    places = common.staged(index.join(asked, "word", "left_semi").select("word", "key", "position"), "places")
    first = common.staged(begin(places, wanted), "begin")
    exact = common.staged(verified(intersected(first, places, wanted), runs, docs), "exact")
    near = intersected(first, places, wanted, distance)
    return index.where("word = ''").select("doc_id", "key", F.col("position").cast("bigint").alias("n_words")), exact, near


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, distance: int = 2) -> DataFrame:
    """Per row: `n_words`, `n_hit` (words inside an occurring window), `n_items`, `items_sha256` (of the item ids as sorted
    strings), `contaminated`, and `n_near` (windows met within `distance` but not exactly).

    A null or empty text has no words and no hits; with no items nothing is hit; rows that agree in id and text share
    results and each keeps its row; a null id is an id like any other; an empty table gives an empty one; other columns
    stay behind.
    """
    rows, exact, near = matched(docs, items, size, distance)
    runs = phrases(items, size).select("phrase", "item_id")
    covered = exact.select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct()
    hit = covered.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = exact.select("key", "phrase").distinct().join(runs, "phrase").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    named = ids.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    close = near.select("key", "phrase").distinct().join(exact.select("key", "phrase").distinct(), ["key", "phrase"], "left_anti")
    missed = close.groupBy("key").agg(F.count(F.lit(1)).alias("n_near"))
    facts = hit.join(named, "key", "full").join(missed, "key", "full")
    out = rows.join(facts, "key", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", "n_words", number("n_hit"), number("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), number("n_near"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Documents without any occurring window, with all their columns."""
    _, exact, _ = matched(docs, items, size)
    bad = common.staged(exact.select("key").distinct(), "contaminated")
    keyed = docs.withColumn("_contaminated_key", F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    return keyed.join(bad.withColumnRenamed("key", "_contaminated_key"), "_contaminated_key", "left_anti").select(*[f"`{c}`" for c in docs.columns])


# Windows as strings of words with a blank after each; a document's places come from the same strings over its own words.
CONTAMINATION_SQL = r"""
WITH lowered AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
runs AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS phrase, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM runs),
places AS (SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM lowered, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT k, s, n, phrase FROM places SEMI JOIN runs USING (n, phrase)),
covered AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM hits JOIN runs USING (phrase)) GROUP BY k),
out AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM lowered LEFT JOIN covered USING (k) LEFT JOIN named USING (k))
SELECT * FROM out
"""
