"""Comments and geometry (G) over the given conversations, embeddings and derived words."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from quire.catalog import derived
from quire.catalog.base import query, table
from quire.operators import comments, geometry

_COMMENTS = """
c AS (SELECT conv_id AS doc_id, turn + 1 AS id, CASE WHEN turn = 0 THEN NULL WHEN turn % 6 = 5 THEN 999 WHEN turn % 4 = 3 THEN turn - 1 ELSE turn END AS reply_to, turn AS ord,
  CASE WHEN turn > 0 AND turn % 2 = 1 THEN ['Accepted', 'None', 'Rejected', '', 'Completed'][turn % 5 + 1] END AS state FROM conversations),
t AS (
  WITH RECURSIVE w AS (
    SELECT doc_id, id, reply_to AS at, 1 AS depth FROM c WHERE reply_to IS NOT NULL
    UNION ALL SELECT w.doc_id, w.id, c.reply_to, depth + 1 FROM w JOIN c ON c.doc_id = w.doc_id AND c.id = w.at WHERE c.reply_to IS NOT NULL AND depth < 64)
  SELECT w.doc_id, w.id, w.at AS root_id, w.depth FROM w JOIN c ON c.doc_id = w.doc_id AND c.id = w.at WHERE c.reply_to IS NULL)"""


def _comments(spark, folder):
    turn = F.col("turn")
    reply = F.when(turn == 0, F.lit(None)).when(turn % 6 == 5, 999).when(turn % 4 == 3, turn - 1).otherwise(turn)
    state = F.get(F.array(*map(F.lit, ("Accepted", "None", "Rejected", "", "Completed"))), (turn % 5).cast("int"))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), (turn + 1).alias("id"), reply.cast("long").alias("reply_to"), F.lit("R").alias("reply_type"), turn.alias("ord"),
        F.when((turn > 0) & (turn % 2 == 1), state).alias("state"), F.lit("Review").alias("state_model"), F.lit("2024-01-01").alias("created"))


@query("G2_thread_roots", f"WITH {_COMMENTS} SELECT doc_id, id, root_id, depth::BIGINT AS depth FROM t")
def roots(spark, folder):
    return comments.thread_roots(_comments(spark, folder))


@query("G2_threads", f"WITH {_COMMENTS} SELECT doc_id, id, root_id, ord, row_number() OVER (PARTITION BY doc_id, root_id ORDER BY ord) AS reply_no FROM t JOIN c USING (doc_id, id)")
def thread_order(spark, folder):
    rows = _comments(spark, folder)
    return comments.threads(rows, comments.thread_roots(rows)).drop("depth")


@query("G3_thread_summary", f"""
WITH {_COMMENTS},
s AS (SELECT doc_id, reply_to AS id, arg_max(state, ord) AS state FROM c WHERE state IS NOT NULL GROUP BY ALL)
SELECT r.doc_id, r.root_id, r.replies, r.depth, CASE WHEN s.state IN ('', 'None') THEN '' ELSE coalesce(s.state, '') END AS state
FROM (SELECT doc_id, root_id, count(*) AS replies, max(depth)::BIGINT AS depth FROM t GROUP BY ALL) r LEFT JOIN s ON s.doc_id = r.doc_id AND s.id = r.root_id
""")
def summary(spark, folder):
    rows = _comments(spark, folder)
    return comments.thread_summary(rows, comments.thread_roots(rows)).withColumn("state", F.coalesce("state", F.lit("")))


_MEASURED = """
v AS (SELECT vec_id, ['Line', 'PolyLine', 'Polygon'][vec_id % 3 + 1] AS subtype, list_transform(range(len(embedding) // 2), lambda i: {'x': embedding[2 * i + 1]::DOUBLE * 1000, 'y': embedding[2 * i + 2]::DOUBLE * 1000}) AS p FROM embeddings),
s AS (SELECT vec_id, subtype, p, len(p) AS n, vec_id % 7 AS doc_id, (1 + vec_id % 7) / 72.0::DOUBLE AS k FROM v),
m AS (SELECT doc_id, vec_id AS id, CASE subtype WHEN 'Line' THEN 'Distance' WHEN 'PolyLine' THEN 'Perimeter' ELSE 'Area' END AS kind,
  CASE subtype WHEN 'Line' THEN sqrt(pow((p[n].x - p[1].x) * k, 2) + pow((p[n].y - p[1].y) * k, 2)) * 2
    WHEN 'PolyLine' THEN list_sum(list_transform(range(1, n), lambda i: sqrt(pow((p[i + 1].x - p[i].x) * k, 2) + pow((p[i + 1].y - p[i].y) * k, 2)) * 2))
    ELSE abs(list_sum(list_transform(range(1, n + 1), lambda i: p[i].x * k * (p[i % n + 1].y * k) - p[i % n + 1].x * k * (p[i].y * k)))) / 2 * 3 END AS value,
  degrees(atan2((p[n].y - p[1].y) * k, (p[n].x - p[1].x) * k)) AS a FROM s)"""


def _measured(spark, folder):
    e = table(spark, folder, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double") * 1000
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.struct(at(i * 2).alias("x"), at(i * 2 + 1).alias("y")))
    subtype = F.get(F.array(*map(F.lit, ("Line", "PolyLine", "Polygon"))), (F.col("vec_id") % 3).cast("int"))
    annotations = e.select((F.col("vec_id") % 7).alias("doc_id"), F.col("vec_id").alias("id"), subtype.alias("subtype"), points.alias("points"))
    scales = e.select((F.col("vec_id") % 7).alias("doc_id")).distinct().select(
        "doc_id", ((1 + F.col("doc_id")) / 72).alias("x_factor"), ((1 + F.col("doc_id")) / 72).alias("y_factor"), F.lit(2.0).alias("distance_factor"), F.lit(3.0).alias("area_factor"))
    return geometry.measure(annotations, scales)


@query("G1_measure", f"WITH {_MEASURED} SELECT doc_id, id, kind, round(value, 4) AS value, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 4) AS angle FROM m")
def measure(spark, folder):
    return _measured(spark, folder).withColumns({"value": F.round("value", 4), "angle": F.round("angle", 4)})


@query("G1_measure_totals", f"WITH {_MEASURED} SELECT doc_id, kind, count(*) AS \"count\", round(sum(round(value, 4)::DECIMAL(28, 4))::DOUBLE, 3) AS total FROM m GROUP BY ALL")
def totals(spark, folder):
    return geometry.measure_totals(_measured(spark, folder)).withColumn("total", F.round(F.col("total").cast("double"), 3))


_SNAP = derived.WORDS + """,
seg AS (SELECT doc_id, page_no, line_no AS seg_id, x AS x0, y + h AS y0, x + w AS x1, y + h + doc_id % 3 AS y1 FROM lines),
pt AS (SELECT doc_id, page_no, (line_no * 100000 + start)::BIGINT AS id, x + start % 7 AS x, y + h + start % 5 - 2 AS y FROM words),
spots AS (SELECT doc_id, page_no, seg_id, 0 AS rank, x0 AS tx, y0 AS ty FROM seg UNION ALL SELECT doc_id, page_no, seg_id, 0, x1, y1 FROM seg
  UNION ALL SELECT doc_id, page_no, seg_id, 1, (x0 + x1) / 2, (y0 + y1) / 2 FROM seg),
cand AS (
  SELECT p.doc_id, p.page_no, p.id, s.rank, s.seg_id, s.tx, s.ty, (s.tx - p.x) * (s.tx - p.x) + (s.ty - p.y) * (s.ty - p.y) AS d FROM pt p JOIN spots s ON s.doc_id = p.doc_id AND s.page_no = p.page_no
  UNION ALL
  SELECT doc_id, page_no, id, 2, seg_id, x0 + t * dx, y0 + t * dy, pow(x0 + t * dx - x, 2) + pow(y0 + t * dy - y, 2)
  FROM (SELECT p.*, s.*, x1 - x0 AS dx, y1 - y0 AS dy,
          CASE WHEN pow(x1 - x0, 2) + pow(y1 - y0, 2) > 0 THEN greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) ELSE 0 END AS t
        FROM pt p JOIN seg s ON s.doc_id = p.doc_id AND s.page_no = p.page_no)),
best AS (SELECT doc_id, page_no, id, arg_min(rank, (rank, d, seg_id, tx, ty)) AS rank, arg_min(tx, (rank, d, seg_id, tx, ty)) AS tx, arg_min(ty, (rank, d, seg_id, tx, ty)) AS ty FROM cand WHERE d <= 36 GROUP BY ALL)"""


@query("G4_snap", f"""
WITH {_SNAP}
SELECT kind, count(*) AS points, round(sum(round(sx, 3)), 2) AS sum_x, round(sum(round(sy, 3)), 2) AS sum_y FROM (
  SELECT CASE rank WHEN 0 THEN 'Endpoint' WHEN 1 THEN 'Midpoint' WHEN 2 THEN 'OnPath' ELSE 'None' END AS kind, coalesce(tx, x) AS sx, coalesce(ty, y) AS sy
  FROM pt LEFT JOIN best USING (doc_id, page_no, id)) GROUP BY kind
""")
def snap(spark, folder):
    lines = derived.lines(spark, folder)
    segments = lines.select("doc_id", "page_no", F.col("line_no").alias("seg_id"), F.col("x").alias("x0"), (F.col("y") + F.col("h")).alias("y0"), (F.col("x") + F.col("w")).alias("x1"),
                            (F.col("y") + F.col("h") + F.col("doc_id") % 3).alias("y1"))
    points = derived.words(spark, folder).select(
        "doc_id", "page_no", (F.col("line_no") * 100000 + F.col("start")).cast("long").alias("id"), (F.col("x") + F.col("start") % 7).alias("x"), (F.col("y") + F.col("h") + F.col("start") % 5 - 2).alias("y"))
    found = geometry.snap(points, segments, 6.0)
    total = lambda c: F.round((F.sum(_thousandths(F.col(c))).cast("decimal(20,0)") * F.lit(Decimal("0.001"))).cast("double"), 2)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def _thousandths(value):
    """The column `round(value, 3)` in thousandths, whole numbers: only values near a half of one, and large ones, go through decimals."""
    near = value * 1000
    plain = (F.abs(near) < 1e12) & (F.abs(near - F.floor(near) - 0.5) > 0.001)
    return F.when(plain, F.floor(near + 0.5)).otherwise((F.round(value, 3).cast("decimal(28,3)") * 1000).cast("long"))


_MARKS = """marks AS (SELECT DISTINCT doc_id, page_no, 60.0::DOUBLE AS x, (18 * (doc_id % 40))::DOUBLE AS y, 200.0::DOUBLE AS w, 30.0::DOUBLE AS h FROM lines)"""


def _marks(spark, folder):
    return derived.pages(spark, folder).select(
        "doc_id", "page_no", F.lit(60.0).alias("x"), (18 * (F.col("doc_id") % 40)).cast("double").alias("y"), F.lit(200.0).alias("w"), F.lit(30.0).alias("h"))


@query("G5_hit_test", f"""
WITH {derived.WORDS},
rects AS (SELECT doc_id, page_no, line_no AS ord, x + 30 AS x, y - 9 AS y, w / 2 AS w, 24.0 AS h FROM lines WHERE w > 0),
pt AS (SELECT doc_id, page_no, line_no * 100000 + start AS id, x, y FROM words),
j AS (SELECT p.doc_id, p.page_no, p.id, r.ord, p.x BETWEEN r.x AND r.x + r.w AND p.y BETWEEN r.y AND r.y + r.h AS exact FROM pt p JOIN rects r ON r.doc_id = p.doc_id AND r.page_no = p.page_no
  AND p.x BETWEEN r.x - 6 AND r.x + r.w + 6 AND p.y BETWEEN r.y - 6 AND r.y + r.h + 6)
SELECT doc_id, page_no::BIGINT AS page_no, id::BIGINT AS id, arg_max(ord, (exact, ord))::BIGINT AS ord, bool_or(exact) AS exact FROM j GROUP BY doc_id, page_no, id
""")
def hit(spark, folder):
    rects = derived.lines(spark, folder).select("doc_id", "page_no", F.col("line_no").alias("ord"), (F.col("x") + 30).alias("x"), (F.col("y") - 9).alias("y"), (F.col("w") / 2).alias("w"), F.lit(24.0).alias("h"))
    points = derived.words(spark, folder).select("doc_id", "page_no", (F.col("line_no") * 100000 + F.col("start")).alias("id"), "x", "y")
    return geometry.hit_test(points, rects, 6.0)


@query("G6_redact_areas", f"""
WITH {derived.WORDS}, {_MARKS},
hit AS (SELECT DISTINCT w.doc_id, w.page_no, w.line_no, w.start FROM words w JOIN marks m USING (doc_id, page_no)
  WHERE (w.x + w.w / 2 BETWEEN m.x AND m.x + m.w AND w.y + w.h / 2 BETWEEN m.y AND m.y + m.h)
     OR greatest(0, least(w.x + w.w, m.x + m.w) - greatest(w.x, m.x)) * greatest(0, least(w.y + w.h, m.y + m.h) - greatest(w.y, m.y)) / (w.w * w.h) >= 0.25)
SELECT doc_id, page_no::BIGINT AS page_no, line_no::BIGINT AS line_no, start, word FROM words ANTI JOIN hit USING (doc_id, page_no, line_no, start)
""")
def redact(spark, folder):
    """Marks are dealt to lines before the words of a line are rows of their own, as words stand at the height of their line."""
    lines = geometry.with_areas(derived.lines(spark, folder), _marks(spark, folder))
    return geometry.outside_areas(derived.words_of(lines, "_marks")).select("doc_id", "page_no", "line_no", "start", "word")


_MERGED = """
i AS (SELECT user_id, floor(value * 100)::BIGINT AS s, floor(value * 100)::BIGINT + event_id % 40 AS e FROM events),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE e > s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM r),
merged AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, run)"""


def _merged(spark, folder):
    start = F.floor(F.col("value") * 100)
    intervals = table(spark, folder, "events").select("user_id", start.alias("start"), (start + F.col("event_id") % 40).alias("end"))
    return geometry.merge_intervals(intervals, ["user_id"], 5)


@query("G7_merge_intervals", f'WITH {_MERGED} SELECT user_id, s AS start, e AS "end" FROM merged')
def merge(spark, folder):
    return _merged(spark, folder)


@query("G7_split_intervals", f"""
WITH {_MERGED}, c AS (SELECT user_id, s, e, (s + 64) // 16 * 16 AS f FROM merged)
SELECT user_id, unnest(list_prepend(s, CASE WHEN f < e THEN range(f, e, 64) ELSE [] END)) AS start, unnest(list_append(CASE WHEN f < e THEN range(f, e, 64) ELSE [] END, e)) AS "end" FROM c
""")
def split(spark, folder):
    return geometry.split_intervals(_merged(spark, folder), 64, 16)
