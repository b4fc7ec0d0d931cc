"""Comparison (D) of the given documents with a derived later version."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import derived
from quire.catalog.base import query, table
from quire.catalog.texts import TOKENS
from quire.operators import compare, units

V = derived.PAGE_VERSIONS


@query("D1_compare_pages", f"""
WITH {V}
SELECT doc_id, page_no::BIGINT AS page_no,
       CASE WHEN coalesce(a.text, '') = coalesce(b.text, '') THEN 'Unchanged' WHEN coalesce(a.text, '') = '' THEN 'Added'
            WHEN coalesce(b.text, '') = '' THEN 'Deleted' ELSE 'Modified' END AS status
FROM (SELECT doc_id, page_no, text FROM page_texts) a FULL JOIN docs_v2 b USING (doc_id, page_no)
""")
def pages(spark, folder):
    return compare.compare_pages(*derived.page_versions(spark, folder))


_PAIRS = """
a AS (SELECT vec_id // 20 AS doc_id, (vec_id % 20) // 2 + 1 AS page_no, embedding FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT vec_id // 20 AS doc_id, (vec_id % 20) // 2 + 1 AS page_no, embedding FROM embeddings WHERE vec_id % 2 = 1),
sims AS (
  SELECT doc_id, page_no, CASE WHEN len(a.embedding) <> len(b.embedding) THEN 0.0 WHEN len(a.embedding) = 0 THEN 1.0 ELSE
    len(list_filter(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE) < 0.1)) / len(a.embedding) END::DOUBLE AS similarity
  FROM a JOIN b USING (doc_id, page_no))"""


def _vector_pairs(spark, folder):
    v = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 20).alias("doc_id"), (F.floor(F.pmod("vec_id", F.lit(20)) / 2) + 1).alias("page_no"),
        F.col("embedding").alias("values"), F.pmod("vec_id", F.lit(2)).alias("_half"))
    return v.where("_half = 0").drop("_half"), v.where("_half = 1").drop("_half")


@query("D2_vector_similarity", f"WITH {_PAIRS} SELECT doc_id, page_no, round(similarity, 6) AS similarity FROM sims")
def similarity(spark, folder):
    return compare.positional_similarity(*_vector_pairs(spark, folder), 0.1).withColumn("similarity", F.round("similarity", 6))


@query("D2_similarity_summary", f"""
WITH {_PAIRS}
SELECT doc_id, count(*) AS compared, round(avg(similarity), 6) AS similarity, count(*) FILTER (similarity < 0.999) AS flagged FROM sims GROUP BY doc_id
""")
def similarity_summary(spark, folder):
    sims = compare.positional_similarity(*_vector_pairs(spark, folder), 0.1)
    return compare.similarity_summary(sims).withColumn("similarity", F.round("similarity", 6))


def _token_lists(spark, folder, folded: bool = True):
    """The documents' tokens in order, a list of each document; nothing is moved for it."""
    found = units.token_lists(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("doc_id").alias("pair_id"), F.transform("tokens", units.fold).alias("tokens") if folded else F.col("tokens"))


def _token_versions(spark, folder):
    """The tokens of the documents, and of a version with every eleventh token changed and every 13th dropped."""
    tokens = _token_lists(spark, folder)
    at = lambda k: k + F.col("pair_id")
    # A changed token is one no document has, so how much two versions share is known.
    changed = F.transform("tokens", lambda t, k: F.when(at(k) % 11 == 0, F.concat(t, F.lit("\u0001"), k.cast("string"))).otherwise(t))
    b = tokens.select("pair_id", F.filter(changed, lambda t, k: at(k) % 13 != 0).alias("tokens"))
    return compare.list_blocks(tokens), compare.list_blocks(b)


def _grown_versions(spark, folder, folded: bool = True):
    """Two versions of the documents: words of its own before every eleventh token, others before every 13th."""
    tokens = _token_lists(spark, folder, folded)

    def grown(every: int, mark: str):
        own = lambda k: F.concat(F.lit(mark), k.cast("string"))
        put = F.transform("tokens", lambda t, k: F.when((k + F.col("pair_id")) % every == 0, F.array(own(k), t)).otherwise(F.array(t)))
        return compare.list_blocks(tokens.select("pair_id", F.flatten(put).alias("tokens")))

    return grown(11, "\u0001a"), grown(13, "\u0001b")


# The one shortest script keeps every token of the documents: no other word stands in both versions.
_GROWN = TOKENS + """,
placed AS (
  SELECT doc_id, token, pos, (pos + doc_id) // 11 + 1 - (doc_id + 10) // 11 AS own_a, (pos + doc_id) // 13 + 1 - (doc_id + 12) // 13 AS own_b,
         ((pos + doc_id) % 11 = 0)::BIGINT AS in_a, ((pos + doc_id) % 13 = 0)::BIGINT AS in_b
  FROM tokens)"""


@query("D3_word_diff", f"""
WITH {_GROWN}
SELECT doc_id AS pair_id, '=' AS op, pos + own_a AS i, pos + own_b AS j FROM placed
UNION ALL SELECT doc_id, '-', pos + own_a - 1, pos + own_b - in_b FROM placed WHERE in_a = 1
UNION ALL SELECT doc_id, '+', pos + own_a, pos + own_b - 1 FROM placed WHERE in_b = 1
""")
def word_diff(spark, folder):
    return compare.script(compare.diff_runs(*_grown_versions(spark, folder)))


@query("D3_edit_counts", f"""
WITH {TOKENS}
SELECT doc_id AS pair_id, count(*) FILTER ((pos + doc_id) % 11 <> 0 AND (pos + doc_id) % 13 <> 0) AS kept,
       count(*) FILTER ((pos + doc_id) % 11 = 0 OR (pos + doc_id) % 13 = 0) AS deleted, count(*) FILTER ((pos + doc_id) % 11 = 0 AND (pos + doc_id) % 13 <> 0) AS inserted
FROM tokens GROUP BY doc_id
""")
def edit_counts(spark, folder):
    """How many words each document keeps, loses and gains: the same for every shortest script."""
    runs = compare.diff_runs(*_token_versions(spark, folder))
    count = lambda op: F.sum(F.when(F.col("op") == op, F.col("n")).otherwise(0))
    return runs.groupBy("pair_id").agg(count("=").alias("kept"), count("-").alias("deleted"), count("+").alias("inserted"))


@query("D4_word_coverage", f"""
WITH {derived.WORDS},
a AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL),
b AS (SELECT doc_id, word, count(*) AS n FROM words WHERE (doc_id + page_no) % 3 <> 0 AND (start + line_no) % 5 <> 0 GROUP BY ALL),
sums AS (SELECT a.doc_id, sum(a.n)::BIGINT AS words, sum(least(a.n, coalesce(b.n, 0)))::BIGINT AS found FROM a LEFT JOIN b USING (doc_id, word) GROUP BY a.doc_id)
SELECT doc_id, words, found, CASE WHEN words >= 20 THEN round(found / words, 6) ELSE -1 END::DOUBLE AS coverage,
       CASE WHEN words >= 20 THEN 'compared' ELSE 'no-text' END AS status FROM sums
""")
def coverage(spark, folder):
    a = derived.words(spark, folder)
    b = a.where("(doc_id + page_no) % 3 <> 0 and (start + line_no) % 5 <> 0")
    return compare.word_coverage(a, b).withColumn("coverage", F.coalesce(F.round("coverage", 6), F.lit(-1.0)))


@query("D5_change_runs", f"""
WITH {_GROWN}
SELECT doc_id AS pair_id, pos AS run, CASE WHEN in_a = 0 THEN 'Inserted' WHEN in_b = 0 THEN 'Deleted' ELSE 'Replaced' END AS kind,
       pos + own_a - in_a AS i, pos + own_b - in_b AS j, in_a AS deleted, in_b AS inserted,
       CASE WHEN in_a = 1 THEN chr(1) || 'a' || pos ELSE '' END AS old_text, CASE WHEN in_b = 1 THEN chr(1) || 'b' || pos ELSE '' END AS new_text
FROM placed WHERE in_a + in_b > 0
""")
def change_runs(spark, folder):
    runs = compare.diff_runs(*_grown_versions(spark, folder))
    return compare.changes(runs, *_grown_versions(spark, folder, folded=False))


@query("D6_fingerprint_diff", f"""
WITH {V}
SELECT doc_id, page_no::BIGINT AS page_no, CASE WHEN a.h IS NULL THEN 'appeared' WHEN b.h IS NULL THEN 'vanished' ELSE 'differs' END AS change
FROM (SELECT doc_id, page_no, sha256(text) AS h FROM page_texts) a FULL JOIN (SELECT doc_id, page_no, sha256(text) AS h FROM docs_v2) b USING (doc_id, page_no)
WHERE a.h IS DISTINCT FROM b.h
""")
def fingerprints(spark, folder):
    return compare.fingerprint_diff(*derived.page_versions(spark, folder))
