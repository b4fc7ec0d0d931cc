"""Rule reports (K) and revisions (R) over facts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import derived
from quire.catalog.base import query, table
from quire.operators import accessibility, findings, links, revisions

FACTS = derived.LINES + """,
facts AS (
  SELECT doc_id, page_no, line_no AS ord, unnest(['image_ppi', 'total_ink', 'line_width']) AS measure,
         unnest([length(text) * 3.0, length(text) * 5.0, length(text) / 200.0])::DOUBLE AS value FROM lines),
rules AS (SELECT * FROM (VALUES ('PP-2.1', 'image_ppi', 'lt', 150.0, NULL, 'Error', 'ppi'), ('PP-2.2', 'image_ppi', 'lt', 300.0, 150.0, 'Warning', 'ppi'),
  ('PP-4.1', 'total_ink', 'gt', 300.05, NULL, 'Warning', '%'), ('PP-5.1', 'line_width', 'lt', 0.25, NULL, 'Warning', 'pt')) v(rule, measure, op, threshold, at_least, severity, unit)),
found AS (
  SELECT doc_id, page_no, ord, rule, severity, value AS measure, unit FROM facts JOIN rules USING (measure)
  WHERE CASE op WHEN 'lt' THEN value < threshold ELSE value > threshold END AND (at_least IS NULL OR value >= at_least))"""


def _facts(spark, folder):
    n = F.length("text")
    entry = lambda name, value: F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"))
    facts = F.array(entry("image_ppi", n * 3), entry("total_ink", n * 5), entry("line_width", n / 200))
    rows = derived.lines(spark, folder).select("doc_id", "page_no", F.col("line_no").cast("long").alias("ord"), F.explode(facts).alias("_f"))
    return rows.select("doc_id", "page_no", "ord", "_f.*")


def _found(spark, folder):
    return findings.run_profile(_facts(spark, folder), findings.DIGITAL_PRINTING)


@query("K1_rule_profile", f"""
WITH {FACTS} SELECT doc_id, page_no::BIGINT AS page_no, ord::BIGINT AS ord, rule, severity, round(measure, 6) AS measure, unit, 1::BIGINT AS "count" FROM found
""")
def profile(spark, folder):
    return _found(spark, folder).drop("message").withColumn("measure", F.round("measure", 6))


@query("K2_cap_findings", f"""
WITH {FACTS},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, rule ORDER BY ord) AS rn, count(*) OVER (PARTITION BY doc_id, page_no, rule) AS n FROM found)
SELECT doc_id, page_no::BIGINT AS page_no, rule, severity, ord::BIGINT AS ord, 1::BIGINT AS "count", '' AS rest FROM r WHERE rn <= 5
UNION ALL SELECT doc_id, page_no, rule, severity, -1, n - 5, 'And ' || (n - 5) || ' more like this on the page.' FROM r WHERE rn = 1 AND n > 5
""")
def cap(spark, folder):
    capped = findings.cap_findings(_found(spark, folder), 5)
    rest = F.when(F.col("ord").isNull(), F.col("message")).otherwise("")
    return capped.select("doc_id", "page_no", "rule", "severity", F.coalesce("ord", F.lit(-1)).alias("ord"), "count", rest.alias("rest"))


@query("K3_report_summary", f"""
WITH {FACTS}
SELECT rule, severity, CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END::BIGINT AS severity_rank, count(*) AS "count", arg_min(doc_id, (doc_id, page_no, ord)) AS first_doc
FROM found GROUP BY ALL
""")
def summary(spark, folder):
    found = _found(spark, folder).withColumn("message", F.col("doc_id").cast("string"))
    return findings.summarize_findings(found).withColumn("first_doc", F.col("first_message").cast("long")).drop("first_message")


@query("K3_report_verdict", f"""
WITH {FACTS}
SELECT doc_id, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos,
       count(*) FILTER (severity = 'Error') = 0 AS passed FROM found GROUP BY doc_id
""")
def verdict(spark, folder):
    return findings.report_verdict(_found(spark, folder), ["doc_id"])


_USES = """
uses AS (SELECT user_id AS doc_id, CASE event_type WHEN 'click' THEN 'Cyan' WHEN 'view' THEN 'Gold' WHEN 'error' THEN 'Black' ELSE 'Spot ' || event_type END AS name, event_id % 20 + 1 AS page_no FROM events),
p AS (SELECT unnest(['Cyan', 'Magenta', 'Yellow', 'Black']) AS name),
listed AS (SELECT DISTINCT doc_id, name, page_no FROM uses
  UNION ALL SELECT d.doc_id, p.name, NULL FROM (SELECT DISTINCT doc_id FROM uses) d, p WHERE NOT EXISTS (SELECT 1 FROM uses u WHERE u.doc_id = d.doc_id AND u.name = p.name))"""


@query("K4_colorant_inventory", f"""
WITH {_USES}
SELECT doc_id, name, name IN ('Cyan', 'Magenta', 'Yellow', 'Black') AS is_process, count(page_no) AS pages, coalesce(min(page_no), 0)::BIGINT AS first_page, coalesce(max(page_no), 0)::BIGINT AS last_page
FROM listed GROUP BY ALL
""")
def inventory(spark, folder):
    name = (F.when(F.col("event_type") == "click", "Cyan").when(F.col("event_type") == "view", "Gold").when(F.col("event_type") == "error", "Black")
            .otherwise(F.concat(F.lit("Spot "), "event_type")))
    uses = table(spark, folder, "events").select(F.col("user_id").alias("doc_id"), name.alias("name"), (F.pmod("event_id", F.lit(20)) + 1).alias("page_no"))
    return findings.inventory_summary(findings.inventory(uses)).na.fill(0, ["first_page", "last_page"])


_HEADS = derived.LINES + """,
heads AS (
  SELECT doc_id, page_no AS parent_id, page_no * 100 + line_no AS ord,
         CASE WHEN doc_id % 17 = 0 AND line_no IN (5, 10) THEN 'H' ELSE 'H' || (1 + (line_no // 5 * (1 + doc_id % 3) + page_no - 1) % 4) END AS type
  FROM lines),
n AS (SELECT *, substring(type, 2, 1)::INT AS level, lag(substring(type, 2, 1)::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM heads WHERE type <> 'H')"""


@query("K5_heading_order", f"""
WITH {_HEADS}
SELECT doc_id, CASE WHEN before IS NULL THEN '14-002' ELSE '14-003' END AS rule, ord::BIGINT AS ord FROM n WHERE (before IS NULL AND level <> 1) OR level > before + 1
UNION ALL SELECT doc_id, '14-007', min(ord) FILTER (type <> 'H') FROM heads GROUP BY doc_id HAVING count(*) FILTER (type = 'H') > 0 AND count(*) FILTER (type <> 'H') > 0
UNION ALL SELECT doc_id, '14-006', min(ord) FROM heads WHERE type = 'H' GROUP BY doc_id, parent_id HAVING count(*) > 1
""")
def headings(spark, folder):
    lines = derived.lines(spark, folder)
    level = 1 + F.pmod(F.floor(F.col("line_no") / 5) * (1 + F.col("doc_id") % 3) + F.col("page_no") - 1, F.lit(4))
    kind = F.when((F.col("doc_id") % 17 == 0) & F.col("line_no").isin(5, 10), "H").otherwise(F.concat(F.lit("H"), level.cast("string")))
    return accessibility.check_headings(lines.select(
        "doc_id", F.col("page_no").alias("parent_id"), (F.col("page_no") * 100 + F.col("line_no")).cast("long").alias("ord"), kind.alias("type")))


@query("K6_duplicate_ids", """
WITH i AS (SELECT user_id AS doc_id, CASE WHEN event_id % 101 = 0 THEN '' ELSE props END AS id FROM events)
SELECT doc_id, id, CASE WHEN id = '' THEN '19-003' ELSE '19-004' END AS rule, CASE WHEN id = '' THEN count(*) ELSE count(*) - 1 END AS "count" FROM i GROUP BY doc_id, id HAVING id = '' OR count(*) > 1
""")
def ids(spark, folder):
    e = table(spark, folder, "events")
    return accessibility.duplicate_ids(e.select(F.col("user_id").alias("doc_id"), F.when(F.pmod("event_id", F.lit(101)) != 0, F.col("props")).alias("id")))


@query("K7_unassociated_cells", f"""
WITH {derived.WORDS},
cells AS (
  SELECT doc_id, page_no AS table_id, line_no AS "row", ord AS col, 1 + (line_no = 0 AND ord = 1)::INT AS row_span,
         CASE WHEN line_no = 0 OR (ord = 0 AND doc_id % 2 = 0) THEN 'TH' ELSE 'TD' END AS type,
         CASE WHEN line_no = 0 AND doc_id % 3 <> 0 AND ord < 3 THEN 'Column' WHEN line_no > 0 AND line_no % 4 = 0 THEN 'Row' WHEN line_no % 9 = 5 THEN 'Both' END AS scope, (doc_id + line_no) % 7 = 0 AS headers
  FROM words)
SELECT doc_id, table_id::BIGINT AS table_id, "row"::BIGINT AS "row", col::BIGINT AS col FROM cells d
WHERE type = 'TD' AND NOT headers AND EXISTS (SELECT 1 FROM cells h WHERE h.doc_id = d.doc_id AND h.table_id = d.table_id AND h.type = 'TH')
  AND NOT EXISTS (SELECT 1 FROM cells h WHERE h.doc_id = d.doc_id AND h.table_id = d.table_id AND h.type = 'TH'
    AND ((h.scope IN ('Row', 'Both') AND h."row" < d."row" + d.row_span AND d."row" < h."row" + h.row_span) OR (h.scope IN ('Column', 'Both') AND h.col = d.col)))
""")
def cells(spark, folder):
    from quire.operators import units

    words = units.words(derived.lines(spark, folder).select("doc_id", "page_no", "line_no", "text"), places=False)
    top, line = F.col("line_no") == 0, F.col("line_no")
    return accessibility.unassociated_cells(words.select(
        "doc_id", F.col("page_no").alias("table_id"), line.alias("row"), F.col("ord").alias("col"), (1 + (top & (F.col("ord") == 1)).cast("int")).alias("row_span"), F.lit(1).alias("col_span"),
        F.when(top | ((F.col("ord") == 0) & (F.col("doc_id") % 2 == 0)), "TH").otherwise("TD").alias("type"),
        F.when(top & (F.col("doc_id") % 3 != 0) & (F.col("ord") < 3), "Column").when((line > 0) & (line % 4 == 0), "Row").when(line % 9 == 5, "Both").alias("scope"),
        ((F.col("doc_id") + line) % 7 == 0).alias("headers"), F.lit(False).alias("empty"))).select("doc_id", "table_id", "row", "col")


@query("K8_limit_coverage", """
WITH s AS (SELECT vec_id // 10 AS doc_id, vec_id % 10 + 1 AS page_no, (i % 8)::DOUBLE AS x, (i // 8)::DOUBLE AS y, v::DOUBLE AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings))
SELECT doc_id, page_no, round(max(value), 6) AS highest, count(*) FILTER (value > 0.2) AS over, round(count(*) FILTER (value > 0.2) / count(*), 6) AS share,
       min(x) FILTER (value > 0.2) AS min_x, max(x) FILTER (value > 0.2) AS max_x, min(y) FILTER (value > 0.2) AS min_y, max(y) FILTER (value > 0.2) AS max_y
FROM s GROUP BY ALL HAVING count(*) FILTER (value > 0.2) > 0
""")
def limits(spark, folder):
    v = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    samples = v.select(F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.pmod("vec_id", F.lit(10)) + 1).alias("page_no"), (F.col("i") % 8).cast("double").alias("x"),
                       F.floor(F.col("i") / 8).cast("double").alias("y"), F.col("v").cast("double").alias("value"))
    return findings.limit_coverage(samples, 0.2).withColumns({c: F.round(c, 6) for c in ("highest", "share")})


@query("K9_descriptions", r"""
WITH d AS (SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title,
  CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 'not a tag' ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS lang FROM pages),
u AS (SELECT page_id AS doc_id, unnest(us) AS uri, unnest(range(len(us))) AS ord FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1) AS us FROM pages)),
f AS (
  SELECT doc_id, unnest(list_filter([CASE WHEN trim(title) = '' THEN '06-003' END, CASE WHEN lang IS NULL THEN '11-001w' END,
    CASE WHEN lang IS NOT NULL AND NOT regexp_matches(lang, '^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$') THEN '11-001' END], lambda x: x IS NOT NULL)) AS rule FROM d
  UNION ALL SELECT doc_id, ['13-004', '17-002', '28-005', '28-012'][ord % 4 + 1] FROM u WHERE ord % 3 = 0)
SELECT doc_id, rule, count(*) AS "count" FROM f GROUP BY ALL
""")
def descriptions(spark, folder):
    pages = table(spark, folder, "pages")
    number = F.col("page_id")
    docs = pages.select(
        number.alias("doc_id"), F.when(number % 5 == 0, " ").otherwise(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.when(number % 7 == 0, F.lit(None)).when(number % 11 == 0, "not a tag").otherwise(F.regexp_extract("html", r'<html lang="([^"]*)"', 1)).alias("lang"))
    kind = F.get(F.array(*map(F.lit, ("Figure", "Formula", "Widget", "Link"))), F.col("ord") % 4)
    elements = links.extract_links(pages).select("doc_id", "ord", kind.alias("type"), F.when(F.col("ord") % 3 != 0, F.col("uri")).alias("alt"), F.lit(None).cast("string").alias("lang"))
    return accessibility.count_by_rule(accessibility.check_descriptions(docs, elements))


@query("K10_nesting", f"""
WITH {derived.LINES},
e AS (SELECT doc_id, page_no * 1000 AS parent, page_no * 1000 + line_no + 1 AS id, line_no AS ord,
  CASE (line_no + doc_id) % 9 WHEN 0 THEN 'THead' WHEN 1 THEN 'TBody' WHEN 2 THEN 'P' WHEN 3 THEN 'Caption' WHEN 4 THEN 'LI' ELSE 'TR' END AS type FROM lines),
t AS (SELECT doc_id, parent AS id, count(*) FILTER (type = 'Caption') AS c, count(*) FILTER (type = 'THead') AS h, count(*) FILTER (type = 'TBody') AS b,
  count(*) FILTER (type IN ('P', 'LI')) AS f, min(ord) AS first, max(ord) AS last, max(ord) FILTER (type = 'Caption') AS cap FROM e GROUP BY ALL)
SELECT doc_id, id::BIGINT AS id, '09-005' AS rule, 'in the wrong place' AS problem FROM e WHERE type = 'LI'
UNION ALL SELECT doc_id, id, '09-004', 'holds other elements' FROM t WHERE f > 0
UNION ALL SELECT doc_id, id, '09-004', 'more than one caption' FROM t WHERE c > 1
UNION ALL SELECT doc_id, id, '09-004', 'caption in the middle' FROM t WHERE c = 1 AND cap <> first AND cap <> last
UNION ALL SELECT doc_id, id, '09-004', 'more than one head' FROM t WHERE h > 1
UNION ALL SELECT doc_id, id, '09-004', 'head or foot without a body' FROM t WHERE h > 0 AND b = 0
""")
def nesting(spark, folder):
    """Every page as a table whose lines are elements of changing types."""
    lines = derived.lines(spark, folder).select("doc_id", "page_no", "line_no")
    kind = F.get(F.array(*map(F.lit, ("THead", "TBody", "P", "Caption", "LI", "TR", "TR", "TR", "TR"))), ((F.col("line_no") + F.col("doc_id")) % 9).cast("int"))
    page = (F.col("page_no") * 1000).cast("long")
    children = lines.select("doc_id", (page + F.col("line_no") + 1).alias("id"), page.alias("parent_id"), F.col("line_no").alias("ord"), kind.alias("type"))
    tables = derived.pages(spark, folder).select("doc_id", page.alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("page_no").alias("ord"), F.lit("Table").alias("type"))
    return accessibility.check_nesting(tables.unionByName(children))


@query("K11_alias_chains", """
WITH RECURSIVE a AS (SELECT p_partkey // 8 AS doc_id, 'T' || p_partkey % 8 AS type, CASE WHEN p_size % 5 = 0 THEN 'P' WHEN p_size % 5 = 1 THEN 'Odd' ELSE 'T' || (p_partkey + 1) % 8 END AS target FROM part WHERE p_size % 7 <> 0),
w AS (SELECT doc_id, type, target, 1 AS n FROM a UNION ALL SELECT w.doc_id, w.type, a.target, n + 1 FROM w JOIN a ON a.doc_id = w.doc_id AND a.type = w.target WHERE n < 64),
e AS (SELECT w.doc_id, w.type, w.target FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = w.doc_id AND a.type = w.target))
SELECT doc_id, a.type, CASE WHEN e.target = 'P' THEN 'P' ELSE '' END AS resolved, CASE WHEN e.target IS NULL THEN '02-003' WHEN e.target = 'P' THEN 'mapped' ELSE '02-001' END AS status
FROM a LEFT JOIN e USING (doc_id, type)
UNION ALL SELECT p_partkey // 8, 'T' || p_partkey % 8, '', '02-001' FROM part WHERE p_size % 7 = 0
""")
def aliases(spark, folder):
    part = table(spark, folder, "part").withColumn("doc_id", F.floor(F.col("p_partkey") / 8)).withColumn("type", F.concat(F.lit("T"), F.col("p_partkey") % 8))
    target = F.when(F.col("p_size") % 5 == 0, "P").when(F.col("p_size") % 5 == 1, "Odd").otherwise(F.concat(F.lit("T"), (F.col("p_partkey") + 1) % 8))
    found = accessibility.resolve_aliases(part.where("p_size % 7 <> 0").select("doc_id", "type", target.alias("target")), part.select("doc_id", "type"))
    return found.withColumn("resolved", F.coalesce("resolved", F.lit("")))


_REVS = """
b AS (SELECT o_custkey AS doc_id, o_orderkey AS obj_id, o_orderstatus AS hash, o_orderpriority AS use FROM orders),
a AS (SELECT doc_id, obj_id, CASE WHEN obj_id % 5 = 0 THEN hash || '2' ELSE hash END AS hash FROM b WHERE obj_id % 17 <> 0
  UNION ALL SELECT doc_id, obj_id + 100000000, 'N' FROM b WHERE obj_id % 19 = 0),
uses AS (SELECT doc_id, obj_id, CASE left(use, 1) WHEN '1' THEN 2 WHEN '2' THEN 4 WHEN '3' THEN 8 WHEN '4' THEN 32 ELSE 64 END AS flag FROM b
  UNION ALL SELECT doc_id, obj_id, 1 FROM b WHERE obj_id % 3 = 0 UNION ALL SELECT doc_id, obj_id + 100000000, 2 FROM b WHERE obj_id % 38 = 0),
diff AS (
  SELECT doc_id, obj_id, CASE WHEN b.hash IS NULL THEN 'new' WHEN a.hash IS NULL THEN 'freed' ELSE 'changed' END AS change,
    coalesce((SELECT arg_max(u.flag, CASE WHEN u.flag IN (32, 64) THEN -u.flag ELSE u.flag END) FROM uses u WHERE u.doc_id = d.doc_id AND u.obj_id = d.obj_id), 16)::BIGINT AS flag
  FROM (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.obj_id, a.obj_id) AS obj_id FROM b FULL JOIN a ON a.doc_id = b.doc_id AND a.obj_id = b.obj_id) d
  LEFT JOIN b USING (doc_id, obj_id) LEFT JOIN a USING (doc_id, obj_id) WHERE b.hash IS DISTINCT FROM a.hash)"""


def _diff(spark, folder):
    b = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("obj_id"), F.col("o_orderstatus").alias("hash"), "o_orderpriority")
    later = F.col("obj_id") + 100_000_000
    a = b.where("obj_id % 17 <> 0").select("doc_id", "obj_id", F.when(F.col("obj_id") % 5 == 0, F.concat("hash", F.lit("2"))).otherwise(F.col("hash")).alias("hash"))
    a = a.unionByName(b.where("obj_id % 19 = 0").select("doc_id", later.alias("obj_id"), F.lit("N").alias("hash")))
    first = F.substring("o_orderpriority", 1, 1)
    flag = F.when(first == "1", 2).when(first == "2", 4).when(first == "3", 8).when(first == "4", 32).otherwise(64)
    uses = b.select("doc_id", "obj_id", flag.alias("flag")).unionByName(b.where("obj_id % 3 = 0").select("doc_id", "obj_id", F.lit(1).alias("flag")))
    uses = uses.unionByName(b.where("obj_id % 38 = 0").select("doc_id", later.alias("obj_id"), F.lit(2).alias("flag")))
    return revisions.revision_diff(b.drop("o_orderpriority"), a, uses)


@query("R1_revision_diff", f"WITH {_REVS} SELECT * FROM diff")
def revision_diff(spark, folder):
    return _diff(spark, folder)


@query("R2_verdict", f"""
WITH {_REVS}, c AS (SELECT doc_id, bit_or(flag) AS changes, count(*) AS objects FROM diff GROUP BY doc_id)
SELECT doc_id, changes, objects, CASE WHEN doc_id % 13 = 0 THEN 'Invalid' WHEN changes & 31 = 0 THEN 'Valid' WHEN doc_id % 29 = 0 THEN 'ModifiedAfterSigning'
  WHEN changes & 16 = 0 AND (CASE doc_id % 4 WHEN 1 THEN false WHEN 2 THEN changes & 4 = 0 ELSE true END) THEN 'ValidWithPermittedChanges' ELSE 'ModifiedAfterSigning' END AS verdict
FROM c
""")
def revision_verdict(spark, folder):
    level = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 4)
    docs = revisions.change_flags(_diff(spark, folder)).withColumns({
        "integrity": F.col("doc_id") % 13 != 0, "level": level, "lock_broken": F.col("doc_id") % 29 == 0, "unverifiable": F.lit(False)})
    return revisions.verdict(docs).select("doc_id", "changes", "objects", "verdict")
