"""Page arrangement (P) over the pages of the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import derived
from quire.catalog.base import query, table
from quire.operators import arrange

P = derived.PAGES + ", counts AS (SELECT doc_id, count(*) AS page_count FROM doc_pages GROUP BY doc_id)"


def _pages(spark, folder):
    return derived.pages(spark, folder)


def _arrangement(spark, folder):
    """Every document reversed and turned once, with its first page repeated at the end; one entry names no page."""
    pages = _pages(spark, folder)
    back = pages.select("doc_id", (1000 - F.col("page_no")).alias("ord"), F.col("page_no").alias("source_page"), F.lit(90).alias("turn"))
    first = pages.where("page_no = 1").select("doc_id", F.lit(2000).alias("ord"), F.lit(1).alias("source_page"), F.lit(180).alias("turn"))
    wrong = pages.where("page_no = 1 and doc_id % 50 = 0").select("doc_id", F.lit(3000).alias("ord"), F.lit(99).alias("source_page"), F.lit(0).alias("turn"))
    return back.unionByName(first).unionByName(wrong)


_ARRANGED = P + """,
arr AS (
  SELECT doc_id, 1000 - page_no AS ord, page_no AS source_page, 90 AS turn FROM doc_pages
  UNION ALL SELECT doc_id, 2000, 1, 180 FROM doc_pages WHERE page_no = 1
  UNION ALL SELECT doc_id, 3000, 99, 0 FROM doc_pages WHERE page_no = 1 AND doc_id % 50 = 0),
arranged AS (
  SELECT a.doc_id, a.source_page, p.width, p.height, (p.rotation + a.turn) % 360 AS rotation, row_number() OVER (PARTITION BY a.doc_id ORDER BY ord) AS page_no
  FROM arr a JOIN doc_pages p ON p.doc_id = a.doc_id AND p.page_no = a.source_page)"""


@query("P1_arrange", f"WITH {_ARRANGED} SELECT doc_id, source_page::BIGINT AS source_page, width, height, rotation::BIGINT AS rotation, page_no FROM arranged")
def arranged(spark, folder):
    return arrange.arrange(_pages(spark, folder), _arrangement(spark, folder))


@query("P1_arrangement_errors", f"""
WITH {_ARRANGED}
SELECT doc_id, ord::BIGINT AS ord, source_page::BIGINT AS source_page, turn::BIGINT AS turn FROM arr
WHERE NOT EXISTS (SELECT 1 FROM doc_pages p WHERE p.doc_id = arr.doc_id AND p.page_no = arr.source_page)
""")
def errors(spark, folder):
    return arrange.arrangement_errors(_pages(spark, folder), _arrangement(spark, folder))


@query("P2_extract_pages", f"""
WITH {P}
SELECT doc_id, page_no::BIGINT AS source_page, width, height, rotation::BIGINT AS rotation, row_number() OVER (PARTITION BY doc_id ORDER BY page_no DESC) AS page_no
FROM doc_pages WHERE page_no <= 2
""")
def extract(spark, folder):
    picks = _pages(spark, folder).where("page_no = 1").select("doc_id", F.explode(F.array(*map(F.lit, (2, 1, 700)))).alias("source_page"))
    return arrange.extract_pages(_pages(spark, folder), picks.withColumn("ord", F.when(F.col("source_page") == 700, 0).otherwise(3 - F.col("source_page"))))


@query("P2_delete_pages", f"""
WITH {P}
SELECT doc_id, page_no::BIGINT AS source_page, width, height, rotation::BIGINT AS rotation, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no
FROM doc_pages WHERE (doc_id + page_no) % 3 <> 0
""")
def delete(spark, folder):
    pages = _pages(spark, folder)
    return arrange.delete_pages(pages, pages.where("(doc_id + page_no) % 3 = 0"))


@query("P2_insert_blank", f"""
WITH {P},
blanks AS (SELECT doc_id, least(1, page_count) AS page_no, 1 AS blank FROM counts),
rows_ AS (SELECT doc_id, page_no, width, height, rotation, page_no AS source_page, 0 AS blank FROM doc_pages
  UNION ALL SELECT doc_id, page_no, 612.0, 792.0, 0, 0, 1 FROM blanks)
SELECT doc_id, width, height, rotation::BIGINT AS rotation, source_page::BIGINT AS source_page, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, blank) AS page_no FROM rows_
""")
def insert(spark, folder):
    pages = _pages(spark, folder)
    blanks = pages.where("page_no = 1").select("doc_id", F.lit(1).alias("index"))
    return arrange.insert_blank(pages, blanks).withColumn("source_page", F.coalesce("source_page", F.lit(0)))


_MERGED = P + """,
src AS (SELECT source AS target_id, doc_id, page_count, CASE WHEN doc_id % 3 = 0 THEN 'Listed ' || doc_id WHEN doc_id % 3 = 1 THEN 'Title ' || lang ELSE NULL END AS title,
          sum(page_count) OVER (PARTITION BY source ORDER BY doc_id) - page_count AS before, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth
        FROM documents JOIN counts USING (doc_id))"""


def _merge(spark, folder):
    docs = table(spark, folder, "documents")
    third = F.pmod("doc_id", F.lit(3))
    sources = docs.select(
        F.col("source").alias("target_id"), F.col("doc_id").alias("ord"), "doc_id",
        F.when(third == 0, F.concat(F.lit("Listed "), "doc_id")).otherwise("").alias("list_title"),
        F.when(third == 1, F.concat(F.lit("Title "), "lang")).alias("title"))
    return arrange.merge(sources, _pages(spark, folder))


@query("P3_merge_pages", f"""
WITH {_MERGED}
SELECT target_id, (before + page_no)::BIGINT AS page_no, doc_id, page_no::BIGINT AS source_page FROM src JOIN doc_pages USING (doc_id)
""")
def merge_pages(spark, folder):
    return _merge(spark, folder)[0]


@query("P3_merge_outline", f"""
WITH {_MERGED} SELECT target_id, nth AS ord, coalesce(title, 'Document ' || nth) AS title, (before + 1)::BIGINT AS page_no FROM src
""")
def merge_outline(spark, folder):
    return _merge(spark, folder)[1]


@query("P4_split", f"""
WITH {_MERGED},
merged AS (SELECT target_id, before + page_no AS page_no FROM src JOIN doc_pages USING (doc_id)),
sizes AS (SELECT target_id, count(*) AS n FROM merged GROUP BY 1),
parts AS (SELECT target_id, unnest(range(1, (n + 29) // 30 + 1)) AS part, n FROM sizes),
spans AS (SELECT target_id, part, least(30, n - 30 * (part - 1)) AS pages, least(30 * part, n) AS last FROM parts)
SELECT target_id AS doc_id, part, (page_no - last + pages)::BIGINT AS page_no, page_no::BIGINT AS source_page
FROM merged JOIN spans USING (target_id) WHERE page_no BETWEEN last - pages + 1 AND last
""")
def split(spark, folder):
    """The merged documents of each source cut into parts of 30 pages and a rest."""
    pages = _merge(spark, folder)[0].select(F.col("target_id").alias("doc_id"), "page_no")
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = sizes.select("doc_id", "_n", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_n") / 30).cast("int"))).alias("part"))
    counts = counts.select("doc_id", "part", F.least(F.lit(30), F.col("_n") - 30 * (F.col("part") - 1)).alias("pages"))
    return arrange.split(pages, counts)


@query("P5_page_range", f"WITH {P} SELECT doc_id, page_no::BIGINT AS page_no, width, height, rotation::BIGINT AS rotation FROM doc_pages WHERE page_no >= 1 AND page_no <= 5 AND page_no % 2 = 1")
def page_range(spark, folder):
    return arrange.page_range(_pages(spark, folder), 1, 5, "odd")


TEMPLATE = "<<Page 1 of n>> | <<1/n>> | <<Date>> | <<d/m/yy>> | <<File>> | <<Bates>> | <<unknown>>"


@query("P6_stamp_pages", f"""
WITH {P},
n AS (SELECT doc_id, page_no, page_count, 'B' || lpad((row_number() OVER (ORDER BY doc_id, page_no) + 99)::VARCHAR, 6, '0') || '-x' AS bates FROM doc_pages JOIN counts USING (doc_id))
SELECT doc_id, page_no::BIGINT AS page_no, page_count, bates,
       'Page ' || page_no || ' of ' || page_count || ' | ' || page_no || '/' || page_count || ' | 2026-09-28 | 28/9/26 | doc' || doc_id || '.txt | ' || bates || ' | <<unknown>>' AS stamp
FROM n
""")
def stamp(spark, folder):
    pages = _pages(spark, folder)
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    listed = pages.select("doc_id", "page_no").join(counts, "doc_id")
    return arrange.stamp(listed, TEMPLATE, F.lit("2026-09-28").cast("date"), F.concat(F.lit("doc"), "doc_id", F.lit(".txt")), prefix="B", suffix="-x", start=100)


@query("P7_outline_spans", f"""
WITH {derived.LINES}, counts AS (SELECT doc_id, max(page_no) AS page_count FROM lines GROUP BY doc_id),
nodes AS (SELECT doc_id, page_no * 100 + line_no AS node_id, page_no, line_no // 20 + page_no AS shown, line_no,
  CASE WHEN line_no = 0 THEN 0 WHEN line_no % 10 = 0 THEN 1 ELSE 2 END AS level, text AS title,
  CASE WHEN line_no = 0 THEN 0 WHEN line_no % 10 = 0 THEN page_no * 100 ELSE page_no * 100 + line_no // 10 * 10 END AS parent_id
  FROM lines WHERE line_no % 10 = 0 OR (line_no % 5 = 0 AND line_no > 10)),
flat AS (
  SELECT n.*, (SELECT min(m.node_id) FROM nodes m WHERE m.doc_id = n.doc_id AND m.node_id > n.node_id AND m.level <= n.level) AS next_id FROM nodes n),
named AS (
  SELECT f.doc_id, f.node_id, f.level, f.shown, m.shown AS next_shown,
         concat_ws(' > ', CASE WHEN f.level = 2 THEN g.title END, CASE WHEN f.level >= 1 THEN p.title END, f.title) AS path
  FROM flat f LEFT JOIN nodes m ON m.doc_id = f.doc_id AND m.node_id = f.next_id
  LEFT JOIN nodes p ON p.doc_id = f.doc_id AND p.node_id = f.parent_id LEFT JOIN nodes g ON g.doc_id = f.doc_id AND g.node_id = p.parent_id)
SELECT doc_id, node_id::BIGINT AS node_id, level::BIGINT AS level, path, shown::BIGINT AS first_page,
       coalesce(greatest(shown, next_shown - 1), page_count + 1)::BIGINT AS last_page
FROM named JOIN counts USING (doc_id)
""")
def outline(spark, folder):
    """An outline of every tenth line under the first line of its page, and of lines between them below those."""
    lines = derived.lines(spark, folder).select("doc_id", "page_no", "line_no", "text")
    page = F.col("page_no") * 100
    parent = F.when(F.col("line_no") == 0, 0).when(F.col("line_no") % 10 == 0, page).otherwise(page + F.floor(F.col("line_no") / 10) * 10)
    nodes = lines.where("line_no % 10 = 0 or (line_no % 5 = 0 and line_no > 10)").select(
        "doc_id", (page + F.col("line_no")).cast("long").alias("node_id"), parent.cast("long").alias("parent_id"), (page + F.col("line_no")).cast("long").alias("ord"),
        F.col("text").alias("title"), (F.floor(F.col("line_no") / 20) + F.col("page_no")).alias("page_no"))
    counts = lines.groupBy("doc_id").agg((F.max("page_no") + 1).alias("page_count"))
    return arrange.outline_spans(nodes, counts)


@query("P8_live_targets", f"""
WITH {_ARRANGED}, m AS (SELECT doc_id, source_page, min(page_no) AS page_no FROM arranged WHERE source_page % 3 <> 0 GROUP BY ALL)
SELECT l.doc_id, l.ord::BIGINT AS ord, m.page_no::BIGINT AS target_page
FROM (SELECT doc_id, page_no AS ord, page_no % 4 + 1 AS target FROM doc_pages) l JOIN m ON m.doc_id = l.doc_id AND m.source_page = l.target
""")
def targets(spark, folder):
    pages = _pages(spark, folder)
    links = pages.select("doc_id", F.col("page_no").alias("ord"), (F.col("page_no") % 4 + 1).alias("target_page"))
    arranged_ = arrange.arrange(pages, _arrangement(spark, folder)).where("source_page % 3 <> 0")
    return arrange.remap_targets(links, arranged_).select("doc_id", "ord", "target_page")
