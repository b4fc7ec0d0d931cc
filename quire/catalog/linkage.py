"""Links, safety and policies (L), duplicates and size (A) over the given pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.base import query, table
from quire.operators import dedupe, links

_WEB = r"""(length(trim(u, ' ')) BETWEEN 1 AND 8192 AND NOT regexp_matches(u, '[\p{Z}\s\p{Cc}\p{Cf}\p{Co}\\]')
  AND (regexp_matches(u, '(?i)^mailto:') OR regexp_matches(u, '(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]+\]|[^/?#:@\[\]]+)(?::\d*)?(?:[/?#]|$)')))"""
_HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*["''']([^"''']*)["''']""".replace("'''", "''")

LINKS = rf"""
uris AS (SELECT page_id AS doc_id, list_prepend(url, regexp_extract_all(html, '{_HREF}', 1)) AS us FROM pages),
links AS (SELECT doc_id, unnest(range(len(us))) AS ord, unnest(us) AS u FROM uris),
classified AS (SELECT doc_id, ord, u AS uri, CASE WHEN {_WEB} THEN 'WebUri' ELSE 'BlockedUri' END AS kind FROM links)"""


def _classified(spark, folder):
    return links.classify_links(links.extract_links(table(spark, folder, "pages"), include_url=True))


@query("L1_classify_links", f"WITH {LINKS} SELECT doc_id, ord::BIGINT AS ord, uri, kind FROM classified")
def classify(spark, folder):
    return _classified(spark, folder).select("doc_id", "ord", "uri", "kind")


@query("L1_link_counts", f"WITH {LINKS} SELECT doc_id, kind, count(*) AS links FROM classified GROUP BY ALL")
def counts(spark, folder):
    return links.link_counts(_classified(spark, folder))


ITEMS = r"""
html_docs AS (SELECT page_id // 60 AS doc_id, page_id % 60 + 1 AS page_no, url, html FROM pages),
scripts AS (SELECT doc_id, page_no, 'JavaScript' AS kind, unnest(s) AS detail, unnest(range(len(s))) AS ord
  FROM (SELECT *, regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1) AS s FROM html_docs)),
outside AS (SELECT doc_id, page_no, 'ExternalLink' AS kind, url AS detail, 1000000 AS ord FROM html_docs),
items AS (SELECT * FROM scripts UNION ALL SELECT * FROM outside WHERE page_no <= 50),
report AS (
  SELECT doc_id, kind, CASE WHEN kind = 'ExternalLink' THEN 'Informational' ELSE 'Elevated' END AS severity, count(*) AS "count",
         array_to_string((list(detail ORDER BY page_no, ord))[1:10], ' | ') AS details
  FROM items GROUP BY ALL)"""


def _html_docs(spark, folder):
    return table(spark, folder, "pages").select(
        F.floor(F.col("page_id") / 60).alias("doc_id"), (F.pmod("page_id", F.lit(60)) + 1).alias("page_no"), "url", "html")


@query("L2_safety_report", f"WITH {ITEMS} SELECT * FROM report")
def safety(spark, folder):
    report = links.safety_report(links.active_items(_html_docs(spark, folder)), links.MAX_DETAILS, links.MAX_PAGES)
    return report.withColumn("details", F.array_join("details", " | "))


@query("L2_safety_verdicts", f"""
WITH {ITEMS}
SELECT d.doc_id, d.pages, coalesce(r.findings, 0)::BIGINT AS findings, coalesce(r.e, 0) = 0 AS clean, d.pages > 50 AS limited
FROM (SELECT doc_id, count(*) AS pages FROM html_docs GROUP BY doc_id) d
LEFT JOIN (SELECT doc_id, count(*) AS findings, count(*) FILTER (severity = 'Elevated') AS e FROM report GROUP BY doc_id) r USING (doc_id)
""")
def verdicts(spark, folder):
    pages = _html_docs(spark, folder)
    return links.safety_verdicts(pages, links.safety_report(links.active_items(pages), links.MAX_DETAILS, links.MAX_PAGES), links.MAX_PAGES)


@query("L3_sanitize", r"""
WITH c AS (SELECT page_id, url, html, regexp_replace(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', '', 'g') AS clean FROM pages)
SELECT page_id, url, clean AS html, len(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>'))::BIGINT AS scripts, 0::BIGINT AS embedded, 0::BIGINT AS launches,
       CASE WHEN len(regexp_extract_all(clean, '(?is)<script\b[^>]*>(.*?)</script\s*>')) = 0 THEN 'clean' ELSE 'failed' END AS verdict
FROM c
""")
def sanitize(spark, folder):
    return links.sanitize(table(spark, folder, "pages"))


_FLAGS = """
flags AS (SELECT doc_id, ((n_chars * 7919 + doc_id * 104729) % 4096)::BIGINT AS flags, 2 + doc_id % 3 AS revision, doc_id % 10 = 0 AS unrestricted FROM documents),
b AS (SELECT *, unrestricted OR flags & 4 <> 0 AS p, flags & 2048 <> 0 AS hp, unrestricted OR flags & 8 <> 0 AS m, unrestricted OR flags & 16 <> 0 AS c,
       unrestricted OR flags & 32 <> 0 AS a, flags & 256 <> 0 AS f9, flags & 1024 <> 0 AS f11 FROM flags),
d AS (SELECT doc_id, [CASE WHEN NOT p THEN 'printing' WHEN NOT (unrestricted OR (p AND (revision <= 2 OR hp))) THEN 'high-quality printing' END,
       CASE WHEN NOT c THEN 'copying' END, CASE WHEN NOT a THEN 'commenting' END, CASE WHEN NOT (a OR (revision > 2 AND f9)) THEN 'form filling' END,
       CASE WHEN NOT m THEN 'editing' END, CASE WHEN NOT (m OR (revision > 2 AND f11)) THEN 'page assembly' END] AS denied FROM b),
s AS (SELECT doc_id, list_filter(denied, lambda x: x IS NOT NULL) AS denied FROM d)"""


@query("L4_permission_audit", f"""
WITH {_FLAGS}
SELECT CASE WHEN len(denied) = 0 THEN '' ELSE 'Not allowed: ' || array_to_string(denied, ', ') END AS summary, count(*) AS documents FROM s GROUP BY ALL
""")
def permissions(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.pmod(F.col("n_chars") * 7919 + F.col("doc_id") * 104729, F.lit(4096)).alias("flags"),
        (2 + F.pmod("doc_id", F.lit(3))).alias("revision"), (F.pmod("doc_id", F.lit(10)) == 0).alias("unrestricted"))
    return links.restriction_counts(links.permission_audit(docs))


@query("L5_policy_violations", f"""
WITH {ITEMS}
SELECT doc_id, 'MaxDocumentSizeBytes' AS rule, 1::BIGINT AS "count" FROM (SELECT doc_id, sum(length(html)) AS n FROM html_docs GROUP BY doc_id) WHERE n > 150000
UNION ALL SELECT doc_id, kind, count(*) FROM items WHERE kind <> 'ExternalLink' GROUP BY ALL
""")
def policy(spark, folder):
    pages = _html_docs(spark, folder)
    docs = pages.groupBy("doc_id").agg(F.sum(F.length("html")).alias("bytes"))
    return links.policy_violations(docs, links.active_items(pages), max_bytes=150_000)


@query("L5_attachment_audit", """
WITH f AS (SELECT p_partkey // 10 AS doc_id, p_partkey % 10 AS ord, p_size AS bytes,
  CASE WHEN p_partkey % 7 = 0 THEN 'attachment ' || (p_partkey % 10 + 1) ELSE p_name || ['.pdf', '.EXE', '.js', '.txt', '.docm'][p_partkey % 5 + 1] END AS shown_name FROM part)
SELECT doc_id, ord, shown_name, bytes::BIGINT AS bytes, regexp_matches(lower(shown_name), '\\.(exe|js|docm)$') AS executable FROM f
""".replace("\\\\", "\\"))
def attachments(spark, folder):
    part = table(spark, folder, "part")
    extension = F.get(F.array(*map(F.lit, (".pdf", ".EXE", ".js", ".txt", ".docm"))), F.pmod("p_partkey", F.lit(5)).cast("int"))
    name = F.when(F.pmod("p_partkey", F.lit(7)) == 0, "").otherwise(F.concat("p_name", extension))
    return links.attachment_audit(part.select(
        F.floor(F.col("p_partkey") / 10).alias("doc_id"), F.pmod("p_partkey", F.lit(10)).alias("ord"), name.alias("name"), F.lit("").alias("key"), F.col("p_size").alias("bytes")))


@query("L6_link_hosts", rf"""
WITH {LINKS}
SELECT lower(regexp_extract(uri, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(uri, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
       count(*) AS links, count(DISTINCT doc_id) AS documents
FROM classified WHERE kind = 'WebUri' GROUP BY ALL
""")
def hosts(spark, folder):
    return links.link_hosts(_classified(spark, folder))


# ---- duplicates and size ---------------------------------------------------------------------------

_HASHED = "h AS (SELECT doc_id AS id, source, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS bytes FROM documents)"


def _items(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "source", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))


@query("A1_duplicate_groups", f"""
WITH {_HASHED}
SELECT hash, min(id) AS keep_id, count(*) - 1 AS duplicates, (sum(bytes) - min(bytes))::BIGINT AS bytes_saved FROM h GROUP BY hash HAVING count(*) > 1
""")
def duplicate_groups(spark, folder):
    return dedupe.duplicate_groups(_items(spark, folder))


@query("A1_dedupe_exact", f"WITH {_HASHED} SELECT id, hash, min(id) OVER (PARTITION BY hash) AS keep_id FROM h")
def dedupe_exact(spark, folder):
    return dedupe.dedupe_exact(_items(spark, folder)).select("id", "hash", "keep_id")


_ITEM_SQL = """
items AS (
  SELECT 'o' || o_orderkey AS id, o_orderstatus AS hash FROM orders
  UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region)"""


@query("A2_dedupe_refs", f"""
WITH {_ITEM_SQL},
nkeep AS (SELECT 'n' || n_nationkey AS id, min('n' || n_nationkey) OVER (PARTITION BY n_regionkey) AS keep_id, n_nationkey FROM nation),
ckeep AS (SELECT 'c' || c_custkey AS id, min('c' || c_custkey) OVER (PARTITION BY c_mktsegment, n.keep_id) AS keep_id, c_custkey
          FROM customer JOIN nkeep n ON n.n_nationkey = c_nationkey),
okeep AS (SELECT 'o' || o_orderkey AS id, min('o' || o_orderkey) OVER (PARTITION BY o_orderstatus, c.keep_id) AS keep_id
          FROM orders JOIN ckeep c ON c.c_custkey = o_custkey)
SELECT id, keep_id FROM nkeep WHERE id <> keep_id UNION ALL SELECT id, keep_id FROM ckeep WHERE id <> keep_id UNION ALL SELECT id, keep_id FROM okeep WHERE id <> keep_id
""")
def dedupe_refs(spark, folder):
    """Orders, customers and nations as objects that refer to each other."""
    key = lambda tag, column: F.concat(F.lit(tag), F.col(column))
    o, c, n, r = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    items = (
        o.select(key("o", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("hash"))
        .union(c.select(key("c", "c_custkey"), "c_mktsegment")).union(n.select(key("n", "n_nationkey"), F.lit("nation"))).union(r.select(key("r", "r_regionkey"), "r_name")))
    refs = (
        o.select(key("o", "o_orderkey").alias("id"), F.lit(0).alias("slot"), key("c", "o_custkey").alias("target"))
        .union(c.select(key("c", "c_custkey"), F.lit(0), key("n", "c_nationkey"))).union(n.select(key("n", "n_nationkey"), F.lit(0), key("r", "n_regionkey"))))
    return dedupe.dedupe_refs(items, refs)


@query("A3_unused_items", """
SELECT 'o' || o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))
UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
""")
def unused(spark, folder):
    """Customers and orders that region 2 does not reach over its nations."""
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    key = lambda tag, column: F.concat(F.lit(tag), F.col(column))
    items = o.select(key("o", "o_orderkey").alias("id")).union(c.select(key("c", "c_custkey")))
    refs = (
        n.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
        .union(c.select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(o.select(key("c", "o_custkey"), key("o", "o_orderkey"))))
    roots = table(spark, folder, "region").where("r_regionkey = 2").select(key("r", "r_regionkey").alias("node"))
    return dedupe.unused(items, refs, roots)


@query("A4_downsample_candidates", """
WITH p AS (SELECT l_suppkey AS doc_id, l_partkey AS image_id, floor(l_extendedprice / 10) AS pw, l_quantity * 40 AS ph, l_quantity * 5 AS a, l_linenumber * 1.0 AS b, l_linenumber * 20.0 AS d FROM lineitem),
q AS (SELECT doc_id, image_id, least(pw / (sqrt(a * a + b * b) / 72), ph / (d / 72)) AS ppi FROM p WHERE pw > 0 AND ph > 0)
SELECT doc_id, image_id, round(min(ppi), 4) AS ppi, count(*) AS placements FROM q GROUP BY ALL HAVING min(ppi) > 150 * 1.5
""")
def downsample(spark, folder):
    """Line items as image placements."""
    p = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("image_id"), F.floor(F.col("l_extendedprice") / 10).alias("pixel_width"),
        (F.col("l_quantity") * 40).alias("pixel_height"), (F.col("l_quantity") * 5).alias("a"), F.col("l_linenumber").cast("double").alias("b"),
        F.lit(0.0).alias("c"), (F.col("l_linenumber") * 20.0).alias("d"))
    return dedupe.downsample_candidates(p, 150.0).withColumn("ppi", F.round("ppi", 4))


@query("A5_size_report", f"""
WITH {_HASHED}, k AS (SELECT *, id = min(id) OVER (PARTITION BY hash) AS kept FROM h)
SELECT source, sum(bytes)::BIGINT AS original, coalesce(sum(bytes) FILTER (kept), 0)::BIGINT AS result, count(*) FILTER (NOT kept) AS removed,
       round(coalesce(sum(bytes) FILTER (kept), 0) / sum(bytes), 6)::DOUBLE AS ratio FROM k GROUP BY source
""")
def size_report(spark, folder):
    items = dedupe.dedupe_exact(_items(spark, folder))
    return dedupe.size_report(items, items.where("id = keep_id"), "source").withColumn("ratio", F.round("ratio", 6))
