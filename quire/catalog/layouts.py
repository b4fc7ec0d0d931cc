"""Layout (E) over lines and words derived from the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import derived
from quire.catalog.base import query
from quire.operators import layout


@query("E1_assemble_lines", f"""
WITH {derived.WORDS}, j AS (SELECT *, y + start % 3 * 0.5 AS jy FROM words)
SELECT doc_id, page_no::BIGINT AS page_no, min(jy + h) AS base, min(x) AS x, min(jy) AS y, max(x + w) - min(x) AS w, max(jy + h) - min(jy) AS h, count(*) AS words,
       string_agg(word, ' ' ORDER BY x, word) AS text FROM j GROUP BY doc_id, page_no, line_no
""")
def lines(spark, folder):
    """Words set up to a point off their line put together again."""
    pages = derived.lines(spark, folder).repartition("doc_id", "page_no")
    words = derived.words_of(pages).withColumn("y", F.col("y") + F.col("start") % 3 * 0.5)
    return layout.assemble_lines(words, 1.5)


_SPACED = derived.LINES + """,
spaced AS (SELECT doc_id, page_no, line_no, CASE WHEN line_no % 9 = 4 THEN (line_no % 7) || '. ' || text ELSE text END AS text, x, (18 * line_no + 12 * (line_no // 6))::DOUBLE AS y, w,
  CASE WHEN size > 12 THEN 16.0 ELSE 12.0 END AS h, size, bold FROM lines),
seen AS (
  SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph, lag(text) OVER o AS pt, y - lag(y) OVER o - lag(h) OVER o AS gap
  FROM spaced WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
near_ AS (SELECT *, list_sort(list_filter(list(CASE WHEN y > py THEN gap END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), lambda g: g IS NOT NULL)) AS gs FROM seen),
flagged AS (SELECT *, (py IS NULL OR gap > greatest(0.8 * ph, coalesce(gs[len(gs) // 4 + 1], 0) + 0.5 * ph) OR abs(h - ph) > 0.25 * ph
  OR (regexp_matches(rtrim(pt), '[.!?:;]$') AND px + pw < greatest(px + pw, x + w) - 4 * ph)
  OR regexp_matches(ltrim(text), '^(?:[•▪▫◦‣∙·–—*-]|(?:[0-9][\\p{L}0-9]{0,3}|\\p{L}|[ivxlcIVXLC]{1,4})[.)])[ \\t]'))::INT AS fresh FROM near_),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_no ORDER BY line_no)::BIGINT AS para_no FROM flagged),
style AS (SELECT doc_id, page_no, para_no, size, bold, sum(length(text)) AS n FROM numbered GROUP BY ALL),
main AS (SELECT doc_id, page_no, para_no, arg_max(size, (n, size, bold)) AS size, arg_max(bold, (n, size, bold)) AS bold FROM style GROUP BY ALL),
paras AS (SELECT n.doc_id, n.page_no, n.para_no, count(*) AS lines, string_agg(n.text, chr(10) ORDER BY n.line_no) AS text, any_value(m.size) AS size, any_value(m.bold) AS bold
  FROM numbered n JOIN main m USING (doc_id, page_no, para_no) GROUP BY ALL),
chars AS (SELECT doc_id, size, sum(length(regexp_replace(text, '[\\p{Z}\\s]', '', 'g'))) AS n FROM spaced GROUP BY ALL),
body AS (SELECT doc_id, arg_min(size, (-n, size)) AS body_size, max(n)::BIGINT AS characters FROM chars GROUP BY doc_id)""".replace("\\\\", "\\")


def _spaced(spark, folder):
    rows = derived.lines(spark, folder)
    n = F.col("line_no")
    return rows.select(
        "doc_id", "page_no", "line_no", F.when(n % 9 == 4, F.concat(n % 7, F.lit(". "), "text")).otherwise(F.col("text")).alias("text"), "x",
        (n * 18 + F.floor(n / 6) * 12).cast("double").alias("y"), "w", F.when(F.col("size") > 12, 16.0).otherwise(12.0).alias("h"), "size", "bold")


@query("E2_paragraph_lines", f"WITH {_SPACED} SELECT doc_id, page_no::BIGINT AS page_no, line_no::BIGINT AS line_no, para_no FROM numbered")
def paragraph_lines(spark, folder):
    return layout.paragraph_lines(_spaced(spark, folder)).select("doc_id", "page_no", "line_no", "para_no")


@query("E2_paragraphs", f"WITH {_SPACED} SELECT doc_id, page_no::BIGINT AS page_no, para_no, lines, text, size::DOUBLE AS size, bold FROM paras")
def paragraphs(spark, folder):
    found = layout.paragraphs(layout.paragraph_lines(_spaced(spark, folder)))
    return found.select("doc_id", "page_no", "para_no", "lines", "text", "size", "bold")


@query("E3_body_style", f"WITH {_SPACED} SELECT doc_id, body_size::DOUBLE AS body_size, characters FROM body")
def body(spark, folder):
    return layout.body_style(_spaced(spark, folder))


@query("E4_headings", f"""
WITH {_SPACED},
c AS (SELECT *, round_even(size, 0) AS s FROM paras JOIN body USING (doc_id)
  WHERE lines <= 3 AND length(trim(text)) BETWEEN 2 AND 200 AND regexp_matches(trim(text), '\\p{{L}}') AND NOT (ends_with(trim(text), '.') AND length(trim(text)) > 60)
    AND ((bold AND size >= 1.15 * body_size) OR size >= 1.6 * body_size))
SELECT doc_id, page_no::BIGINT AS page_no, para_no, text, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY s DESC), 3) AS level FROM c
""".replace("\\\\", "\\"))
def headings(spark, folder):
    lines_ = _spaced(spark, folder)
    paras = layout.paragraphs(layout.paragraph_lines(lines_))
    return layout.headings(paras, layout.body_style(lines_)).select("doc_id", "page_no", "para_no", "text", "level")


@query("E4_reader_headings", f"""
WITH {_SPACED},
pc AS (SELECT doc_id, page_no, size, sum(length(regexp_replace(text, '[\\p{{Z}}\\s]', '', 'g'))) AS n FROM spaced GROUP BY ALL),
pb AS (SELECT doc_id, page_no, arg_min(size, (-n, size)) AS body_size FROM pc GROUP BY ALL),
c AS (SELECT *, round_even(size / body_size, 1) AS s FROM paras JOIN pb USING (doc_id, page_no) WHERE lines <= 3 AND length(trim(text)) BETWEEN 1 AND 200 AND size >= 1.25 * body_size)
SELECT doc_id, page_no::BIGINT AS page_no, para_no, text, least(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY s DESC), 6) AS level FROM c
""".replace("\\\\", "\\"))
def reader_headings(spark, folder):
    lines_ = _spaced(spark, folder)
    paras = layout.paragraphs(layout.paragraph_lines(lines_))
    return layout.headings(paras, layout.body_style(lines_, keys=layout.PAGE), "reader").select("doc_id", "page_no", "para_no", "text", "level")


@query("E5_list_groups", f"""
WITH {derived.LINES},
t AS (SELECT doc_id, (page_no - 1) * 40 + line_no AS ord, (line_no + doc_id) % 8 AS k, line_no, text FROM lines),
m AS (SELECT *, CASE WHEN k BETWEEN 1 AND 5 THEN 'decimal' WHEN k = 6 THEN 'bullet' END AS format, CASE WHEN k = 3 AND line_no % 5 = 0 THEN 9 ELSE k END AS v, CASE WHEN k = 6 THEN '•' ELSE '%1.' END AS style FROM t),
l AS (SELECT *, lag(format) OVER o AS pf, lag(v) OVER o AS pv, lag(ord) OVER o AS po FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
b AS (SELECT *, sum(CASE WHEN pf IS NULL OR format IS NULL OR pf <> format OR (format = 'decimal' AND v <> pv + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM l),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS items, min(ord) OVER (PARTITION BY doc_id, run) AS list_start FROM b WHERE format IS NOT NULL)
SELECT doc_id, ord::BIGINT AS ord, format, style, CASE WHEN format = 'bullet' THEN 0 ELSE v END::BIGINT AS value, 0::BIGINT AS level, list_start::BIGINT AS list_start, items
FROM g WHERE items > 1 OR format = 'bullet'
""")
def lists(spark, folder):
    """Every run of five lines numbered 1 to 5 (some with a wrong number), then a bullet and two plain lines."""
    rows = derived.lines(spark, folder)
    k = (F.col("line_no") + F.col("doc_id")) % 8
    number = F.when((k == 3) & (F.col("line_no") % 5 == 0), 9).otherwise(k)
    text = F.when(k.between(1, 5), F.concat(number.cast("string"), F.lit(". x"), "text")).when(k == 6, F.concat(F.lit("• x"), "text")).otherwise(F.concat(F.lit("Plain"), "text"))
    lines_ = rows.select("doc_id", ((F.col("page_no") - 1) * 40 + F.col("line_no")).cast("long").alias("ord"), text.alias("text"), "x", "w")
    return layout.list_groups(lines_, keep=()).select("doc_id", "ord", "format", "style", "value", "level", "list_start", "items")


# Twelve lines: marker, value, position and level of ten items, and two plain lines. Positions drift up to six points off the
# first of their level, and levels are ten points apart.
_LEVELS = [
    ("1. ", "%1.", 1, 72, 0), ("1) ", "%1)", 1, 82, 1), ("(1) ", "(%1)", 1, 92, 2), ("(2) ", "(%1)", 2, 98, 2), ("2) ", "%1)", 2, 87, 1),
    ("(1) ", "(%1)", 1, 93, 2), ("2. ", "%1.", 2, 76, 0), ("1) ", "%1)", 1, 80, 1), ("2) ", "%1)", 2, 86, 1), ("3. ", "%1.", 3, 69, 0)]


@query("E5_list_levels", f"""
WITH {derived.LINES},
t AS (SELECT doc_id, (page_no - 1) * 40 + line_no AS ord FROM lines),
m(r, style, value, level) AS (VALUES {", ".join(f"({r}, '{style}', {value}, {level})" for r, (_, style, value, _, level) in enumerate(_LEVELS))}),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ord // 12) AS items FROM t JOIN m ON r = ord % 12)
SELECT doc_id, ord::BIGINT AS ord, 'decimal' AS format, style, value::BIGINT AS value, level::BIGINT AS level, (ord // 12 * 12)::BIGINT AS list_start, items FROM g WHERE items > 1
""")
def list_levels(spark, folder):
    """Lists of three levels whose markers drift."""
    rows = derived.lines(spark, folder).withColumn("ord", ((F.col("page_no") - 1) * 40 + F.col("line_no")).cast("long"))
    r = (F.col("ord") % 12).cast("int")
    mark = F.get(F.array(*[F.lit(m) for m, *_ in _LEVELS]), r)
    x = F.get(F.array(*[F.lit(float(x)) for *_, x, _ in _LEVELS]), r)
    lines_ = rows.select("doc_id", "ord", F.concat(F.coalesce(mark, F.lit("Plain")), F.lit("x"), "text").alias("text"), F.coalesce(x, F.lit(72.0)).alias("x"), "w")
    return layout.list_groups(lines_, keep=()).select("doc_id", "ord", "format", "style", "value", "level", "list_start", "items")


_REPEATED = derived.LINES + r""",
edge AS (SELECT source AS doc_id, doc_id * 100 + page_no AS page_no, line_no AS ord, text, (line_no * 19.5)::DOUBLE AS y, 12.0 AS h,
  CASE WHEN line_no * 19.5 < 0.09 * 792 AND line_no * 19.5 + 12 < 0.12 * 792 THEN 'top' WHEN line_no * 19.5 + 12 > 0.91 * 792 AND line_no * 19.5 > 0.88 * 792 THEN 'bottom' END AS zone FROM lines),
np AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM edge GROUP BY doc_id),
k AS (SELECT e.*, regexp_replace(regexp_replace(lower(trim(text)), '\p{Nd}+', '#', 'g'), '[\p{Z}\s]+', ' ', 'g') AS key, np.n AS page_count,
  CASE WHEN np.n <= 4 THEN greatest(2, ceil(np.n / 2)) ELSE greatest(3, ceil(np.n * 0.04)) END AS need FROM edge e JOIN np USING (doc_id) WHERE zone IS NOT NULL AND trim(text) <> ''),
md AS (SELECT *, list_sort(list(y) OVER w)[(count(*) OVER w) // 2 + 1] AS middle_y FROM k WINDOW w AS (PARTITION BY doc_id, zone, key)),
f AS (SELECT doc_id, zone, key, page_no, min(ord) AS ord, arg_min(text, ord) AS text, any_value(need) AS need, any_value(page_count) AS page_count FROM md WHERE abs(y - middle_y) <= 8 GROUP BY ALL),
rep AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, zone, key) AS on_pages FROM f) WHERE on_pages >= need)"""


def _edges(spark, folder):
    """Each source as one document whose pages are those of its documents."""
    return derived.lines(spark, folder, "source").select(
        F.col("source").alias("doc_id"), (F.col("doc_id") * 100 + F.col("page_no")).alias("page_no"), F.col("line_no").alias("ord"), "text",
        (F.col("line_no") * 19.5).alias("y"), "h")


def _repeated(spark, folder, texts=True):
    return layout.repeated_lines(_edges(spark, folder), share=0.04, texts=texts)


@query("E6_repeated_lines", f"WITH {_REPEATED} SELECT doc_id, zone, key, page_no, ord::BIGINT AS ord, text, page_count, on_pages FROM rep")
def repeated(spark, folder):
    return _repeated(spark, folder).select("doc_id", "zone", "key", "page_no", "ord", "text", "page_count", "on_pages")


@query("E6_strip_repeated", f"""
WITH {_REPEATED}
SELECT doc_id, count(*) AS lines, sum(length(text))::BIGINT AS characters FROM edge e WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.doc_id = e.doc_id AND r.page_no = e.page_no AND r.ord = e.ord) GROUP BY doc_id
""")
def strip(spark, folder):
    """Only the length of a line is moved to the repeated ones."""
    edges = _edges(spark, folder).select("doc_id", "page_no", "ord", F.length("text").alias("characters"))
    left = layout.strip_repeated(edges, _repeated(spark, folder, texts=False))
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("characters").alias("characters"))


@query("E7_page_numbers", """
WITH d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source AS doc_id, unnest([0, 1, 2]) AS t0, max(n) AS pages FROM d GROUP BY source
""".replace("SELECT source AS doc_id, unnest([0, 1, 2]) AS t0, max(n) AS pages", """SELECT source AS doc_id, 'bottom' AS zone, 'page # of # in part #' AS key, unnest([0, 1, 2])::BIGINT AS token,
       unnest(['PAGE', 'NUMPAGES', CASE WHEN max(n) > 12 THEN 'literal' ELSE 'same' END]) AS field, unnest([CASE WHEN max(n) > 12 THEN 2 ELSE 1 END, max(n), CASE WHEN max(n) > 12 THEN max(n) - 1 ELSE max(n) END])::BIGINT AS runs, max(n) AS on_pages"""))
def page_numbers(spark, folder):
    """A footer on each document of a source: its page, starting again at 100 after the twelfth, the count, and a part."""
    from pyspark.sql import Window as W

    from quire.catalog.base import table

    docs = table(spark, folder, "documents").select("source", "doc_id")
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    pages = docs.withColumn("p", place).join(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source")
    number = F.when(F.col("p") > 12, F.col("p") + 88).otherwise(F.col("p"))
    text = F.concat(F.lit("Page "), number, F.lit(" of "), "n", F.lit(" in part "), F.when(F.col("p") > 12, 2).otherwise(1))
    repeated_ = pages.select(F.col("source").alias("doc_id"), F.lit("bottom").alias("zone"), F.lit("page # of # in part #").alias("key"), F.col("p").alias("page_no"), F.col("n").alias("page_count"), text.alias("text"))
    return layout.page_number_fields(repeated_)


def _columns(spark, folder):
    """Pages set in two columns, with every ninth line across both."""
    rows = derived.lines(spark, folder)
    n = F.col("line_no")
    x = F.when(n % 9 == 8, 72.0).when(n % 2 == 0, 72.0).otherwise(330.0)
    w = F.when(n % 9 == 8, 468.0).otherwise(F.least(F.length("text") * 6.0, F.lit(210.0)))
    return rows.select("doc_id", "page_no", n.alias("id"), x.alias("x"), (F.floor(n / 2) * 18.0).alias("y"), w.alias("w"), "h")


# Strip by strip: how much text covers each point of a page's width, then the emptiest strips in turn.
_GUTTERS = derived.LINES + """,
bx AS (
  SELECT doc_id, page_no, line_no AS id, CASE WHEN line_no % 9 = 8 THEN 72.0 WHEN line_no % 2 = 0 THEN 72.0 ELSE 330.0 END::DOUBLE AS x, (line_no // 2 * 18)::DOUBLE AS y,
         CASE WHEN line_no % 9 = 8 THEN 468.0 ELSE least(length(text) * 6.0, 210.0) END::DOUBLE AS w, h FROM lines),
ub AS (SELECT *, x AS l, x + w AS r FROM bx WHERE w > 0),
pg AS (SELECT doc_id, page_no, min(l) AS l0, max(r) - min(l) AS width, sum(h) AS total FROM ub GROUP BY ALL HAVING count(*) >= 6 AND max(r) - min(l) BETWEEN 150 AND 5000),
st AS (SELECT *, unnest(range(ceil(width)::BIGINT + 1)) AS k FROM pg),
cov AS (SELECT s.doc_id, s.page_no, s.l0, s.width, s.total, s.k, coalesce(sum(u.h), 0) AS c FROM st s LEFT JOIN ub u ON u.doc_id = s.doc_id AND u.page_no = s.page_no AND floor(u.l - s.l0) <= s.k AND s.k < ceil(u.r - s.l0) GROUP BY ALL),
fl AS (SELECT doc_id, page_no, list_sort(list(c))[floor(0.9 * (count(*) - 1))::BIGINT + 1] AS f FROM cov GROUP BY ALL),
lo AS (SELECT cov.*, f, c <= 0.2 * f AS low, sum((c > 0.2 * f)::INT) OVER (PARTITION BY doc_id, page_no ORDER BY k) AS run FROM cov JOIN fl USING (doc_id, page_no)),
ca AS (SELECT *, min(c) OVER (PARTITION BY doc_id, page_no, run) AS least_ FROM lo WHERE low),
ti AS (SELECT doc_id, page_no, run, l0, width, total, min(k) AS a, max(k) + 1 AS b, max(c) AS worst, min(k) FILTER (c <= least_ + 0.02 * f) AS ta, max(k) FILTER (c <= least_ + 0.02 * f) + 1 AS tb FROM ca GROUP BY ALL),
fit AS (SELECT *, l0 + ta AS g0, l0 + tb AS g1, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY worst, b - a DESC, a) AS rk FROM ti
  WHERE b - a >= 4 AND (a + b) / 2 > 0.15 * width AND (a + b) / 2 < 0.85 * width AND tb - ta >= 4),
m1 AS (SELECT f.doc_id, f.page_no, f.rk, f.g0, f.g1, f.width, f.total FROM fit f JOIN ub u USING (doc_id, page_no) GROUP BY ALL
  HAVING coalesce(sum(u.h) FILTER (u.r <= f.g0 + 1), 0) >= 0.2 * f.total AND coalesce(sum(u.h) FILTER (u.l >= f.g1 - 1), 0) >= 0.2 * f.total),
g1 AS (SELECT * FROM m1 QUALIFY rk = min(rk) OVER (PARTITION BY doc_id, page_no)),
pr AS (SELECT f.doc_id, f.page_no, f.rk, f.g0, f.g1, f.total, least(f.g0, g.g0) AS a0, least(f.g1, g.g1) AS a1, greatest(f.g0, g.g0) AS b0, greatest(f.g1, g.g1) AS b1 FROM fit f JOIN g1 g USING (doc_id, page_no)
  WHERE f.rk > g.rk AND abs((f.g0 + f.g1) / 2 - (g.g0 + g.g1) / 2) >= 0.2 * f.width),
m2 AS (SELECT p.doc_id, p.page_no, p.rk, p.g0, p.g1 FROM pr p JOIN ub u USING (doc_id, page_no) GROUP BY p.doc_id, p.page_no, p.rk, p.g0, p.g1, p.total, p.a0, p.a1, p.b0, p.b1
  HAVING coalesce(sum(u.h) FILTER (u.r <= p.a0 + 1), 0) >= 0.15 * p.total AND coalesce(sum(u.h) FILTER (u.l >= p.a1 - 1 AND u.r <= p.b0 + 1), 0) >= 0.15 * p.total
     AND coalesce(sum(u.h) FILTER (u.l >= p.b1 - 1), 0) >= 0.15 * p.total),
gut AS (SELECT doc_id, page_no, g0, g1 FROM g1 UNION ALL SELECT doc_id, page_no, g0, g1 FROM m2 QUALIFY rk = min(rk) OVER (PARTITION BY doc_id, page_no)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY col, band, x, y, id) AS reading_no FROM (
    SELECT *, sum(CASE WHEN py IS NULL OR least(y + h, py + ph) - greatest(y, py) <= 0.5 * least(h, ph) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, col ORDER BY y, x, id) AS band FROM (
      SELECT *, lag(y) OVER c AS py, lag(h) OVER c AS ph FROM (
        SELECT bx.*, (SELECT count(*) FROM gut g WHERE g.doc_id = bx.doc_id AND g.page_no = bx.page_no AND (g.g0 + g.g1) / 2 <= bx.x + bx.w / 2) AS col FROM bx)
      WINDOW c AS (PARTITION BY doc_id, page_no, col ORDER BY y, x, id))))"""


@query("E8_gutters", f"WITH {_GUTTERS} SELECT doc_id, page_no::BIGINT AS page_no, g0 AS g_from, g1 AS g_to FROM gut")
def gutters(spark, folder):
    return layout.gutters(_columns(spark, folder))


@query("E9_reading_order", f'WITH {_GUTTERS} SELECT doc_id, page_no::BIGINT AS page_no, id::BIGINT AS id, col AS "column", reading_no FROM ordered')
def reading_order(spark, folder):
    rows = _columns(spark, folder)
    return layout.reading_order(rows, layout.gutters(rows)).select("doc_id", "page_no", "id", "column", "reading_no")
