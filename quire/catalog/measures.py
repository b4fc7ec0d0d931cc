"""Metrics (M), gates (Q) and recent lists (N2) over the given events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.base import query, table
from quire.operators import metrics
from quire.plans import sizes

PM = """
pm AS (
  SELECT user_id AS doc_id, event_id % 20 + 1 AS page_no, event_id, least(value / 500, 1)::DOUBLE AS fallback_area, value AS ms,
         CASE WHEN value < 20 THEN []::VARCHAR[] WHEN value < 60 THEN [event_type, event_type] ELSE [event_type, 'large'] END AS reasons
  FROM events),
first_pm AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY event_id) = 1)"""


def page_metrics(spark, folder):
    e = table(spark, folder, "events")
    reasons = (
        F.when(F.col("value") < 20, F.array().cast("array<string>"))
        .when(F.col("value") < 60, F.array("event_type", "event_type")).otherwise(F.array("event_type", F.lit("large"))))
    return e.select(
        F.col("user_id").alias("doc_id"), (F.pmod("event_id", F.lit(20)) + 1).alias("page_no"), "event_id",
        F.least(F.col("value") / 500, F.lit(1.0)).alias("fallback_area"), F.col("value").alias("ms"), reasons.alias("reasons"))


def _first(spark, folder):
    return metrics.first_per_key(page_metrics(spark, folder), ["doc_id", "page_no"], ["event_id"])


@query("M1_timing_summary", """
WITH v AS (SELECT event_type, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM events),
g AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM v WHERE NOT isnan(value)),
s AS (SELECT event_type, max(n) AS count, avg(value) FILTER (r IN ((n + 1) // 2, n // 2 + 1)) AS median,
        max(value) FILTER (r = ceil(0.95 * n)) AS p95, max(value) FILTER (r = ceil(0.99 * n)) AS p99, min(value) AS least, max(value) AS most, avg(value) AS mean FROM g GROUP BY event_type)
SELECT event_type, count, round(median, 6) AS median, p95, p99, least, most, round(mean, 6) AS mean, (SELECT count(*) FROM v WHERE v.event_type = s.event_type AND isnan(value)) AS refused FROM s
""")
def timing(spark, folder):
    value = F.when(F.pmod("event_id", F.lit(97)) == 0, float("nan")).otherwise(F.col("value"))
    samples = table(spark, folder, "events").select("event_type", value.alias("value"))
    return metrics.summarize(samples, ["event_type"]).withColumns({"median": F.round("median", 6), "mean": F.round("mean", 6)})


@query("M2_coverage", f"""
WITH {PM}
SELECT doc_id, count(*) AS pages, count(*) FILTER (len(reasons) = 0) AS full_pages, round(count(*) FILTER (len(reasons) = 0) / count(*), 6) AS page_coverage,
       round(1 - avg(greatest(least(fallback_area, 1), 0)), 6) AS area_coverage
FROM first_pm GROUP BY doc_id
""")
def coverage(spark, folder):
    found = metrics.coverage(_first(spark, folder), ["doc_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("page_coverage", "area_coverage")})


@query("M2_reason_counts", f"WITH {PM} SELECT reason, count(*) AS pages FROM (SELECT unnest(list_distinct(reasons)) AS reason FROM first_pm) GROUP BY reason")
def reasons(spark, folder):
    return metrics.reason_counts(_first(spark, folder))


@query("M3_first_record", f"WITH {PM} SELECT doc_id, page_no, event_id, ms FROM first_pm")
def first(spark, folder):
    return _first(spark, folder).select("doc_id", "page_no", "event_id", "ms")


@query("M4_bucket_counts", f"""
WITH {PM},
b AS (SELECT doc_id, page_no, CASE WHEN ms * 4 <= 72 THEN 72 WHEN ms * 4 <= 96 THEN 96 WHEN ms * 4 <= 120 THEN 120 WHEN ms * 4 <= 150 THEN 150 WHEN ms * 4 <= 180 THEN 180
  WHEN ms * 4 <= 220 THEN 220 WHEN ms * 4 <= 300 THEN 300 ELSE round_even(ms * 4 / 50.0, 0) * 50 END::BIGINT AS bucket FROM pm)
SELECT bucket, count(*) AS hits, count(DISTINCT (doc_id, page_no)) AS pages, count(DISTINCT doc_id) AS documents FROM b GROUP BY bucket
""")
def buckets(spark, folder):
    return metrics.bucket_counts(page_metrics(spark, folder).withColumn("dpi", F.col("ms") * 4), "dpi")


@query("Q1_corpus_summary", """
WITH r AS (SELECT event_type <> 'error' AS opened, value < 90 AS other_opened, value < 10 AS typed, event_id % 7 AS pages, event_id % 7 // 2 AS classified, event_id % 7 // 4 AS full_pages FROM events)
SELECT count(*) AS files, count(*) FILTER (other_opened) AS other_opened, count(*) FILTER (opened) AS opened, count(*) FILTER (NOT opened AND other_opened) AS failed_where_other_opened,
       count(*) FILTER (NOT opened AND NOT typed) AS untyped_errors, sum(pages)::BIGINT AS pages, round(sum(classified) / sum(pages), 4) AS classified_ratio,
       round(sum(full_pages) / sum(classified), 4) AS full_ratio, round(sum(full_pages * 0.5) / sum(classified), 4)::DOUBLE AS area_ratio FROM r
""")
def summary(spark, folder):
    e = table(spark, folder, "events")
    pages = F.pmod("event_id", F.lit(7))
    return metrics.corpus_summary(e.select(
        (F.col("event_type") != "error").alias("opened"), (F.col("value") < 90).alias("other_opened"), (F.col("value") < 10).alias("typed_error"),
        pages.alias("pages"), F.floor(pages / 2).alias("classified"), F.floor(pages / 4).alias("full_pages"), (F.floor(pages / 4) * 0.5).alias("area")))


@query("Q2_top_reasons", """SELECT props, count(*) AS "count" FROM events GROUP BY props ORDER BY count(*) DESC, props LIMIT 25""")
def top(spark, folder):
    return metrics.top_reasons(table(spark, folder, "events"), "props")


@query("Q2_worst_pages", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 15")
def worst(spark, folder):
    return metrics.worst(table(spark, folder, "events").select("event_id", "user_id", "value"), "value", ["event_id"])


_HALVES = """
b AS (SELECT event_type AS measure, sum(round(value * 100)::BIGINT) / 100 AS value FROM events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY 1),
c AS (SELECT event_type AS measure, sum(round(value * 100)::BIGINT) / 100 AS value FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY 1)"""

_RULES = [("click", "at_most_limit", 0.01, 5.0), ("purchase", "at_least", 0.0, 0.0), ("signup", "ratio", 0.0, 100.0), ("error", "at_most", 0.0, 0.0)]


@query("Q3_regression_gate", f"""
WITH {_HALVES},
t AS (SELECT * FROM (VALUES {", ".join(map(str, _RULES))}) v(measure, rule, relative, absolute)),
j AS (SELECT measure, b.value AS baseline, c.value AS current, rule,
  CASE WHEN rule = 'at_most_limit' THEN b.value * (1 + relative) + absolute WHEN rule = 'ratio' THEN b.value - absolute ELSE b.value END AS lim
  FROM b FULL JOIN c USING (measure) LEFT JOIN t USING (measure))
SELECT measure, coalesce(baseline, -1)::DOUBLE AS baseline, coalesce(current, -1)::DOUBLE AS current, round(coalesce(lim, -1), 4)::DOUBLE AS "limit",
       round(CASE WHEN baseline IS NULL OR current IS NULL OR baseline = 0 THEN 0 ELSE (current - baseline) / baseline END, 6)::DOUBLE AS change,
       CASE WHEN baseline IS NULL THEN 'new' WHEN current IS NULL THEN 'missing' WHEN rule IS NULL THEN 'reported'
            WHEN (rule IN ('at_most_limit', 'at_most') AND current > lim) OR (rule NOT IN ('at_most_limit', 'at_most') AND current < lim) THEN 'failed'
            WHEN baseline = current THEN 'same' ELSE 'passed' END AS verdict
FROM j
""")
def gate(spark, folder):
    e = table(spark, folder, "events")
    half = lambda rest, left_out: e.where((F.pmod("event_id", F.lit(2)) == rest) & (F.col("event_type") != left_out)).groupBy(
        F.col("event_type").alias("measure")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("value"))
    rules = sizes.rules(spark, _RULES, "measure string, rule string, relative double, absolute double")
    found = metrics.gate(half(0, "view"), half(1, "error"), rules)
    rounded = {"limit": F.round(F.coalesce("limit", F.lit(-1.0)), 4), "change": F.round("change", 6)}
    return found.withColumns({**rounded, "baseline": F.coalesce("baseline", F.lit(-1.0)), "current": F.coalesce("current", F.lit(-1.0))})


@query("Q3_new_reasons", """
WITH b AS (SELECT props AS reason, count(*) AS was FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT props AS reason, count(*) AS pages FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT reason, pages, coalesce(was, 0) AS was FROM c LEFT JOIN b USING (reason) WHERE pages > coalesce(was, 0)
""")
def new_reasons(spark, folder):
    e = table(spark, folder, "events")
    half = lambda rest: e.where(F.pmod("event_id", F.lit(2)) == rest).groupBy(F.col("props").alias("reason")).agg(F.count(F.lit(1)).alias("pages"))
    return metrics.new_reasons(half(0), half(1))


_SNAPS = """
b AS (SELECT source || '/' || doc_id AS path, n_chars AS bytes FROM documents WHERE doc_id % 5 <> 0),
c AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN n_chars + doc_id % 11 - 5 ELSE n_chars END AS bytes FROM documents WHERE doc_id % 7 <> 0),
d AS (SELECT path, b.bytes AS was, c.bytes AS now_ FROM b FULL JOIN c USING (path) WHERE b.bytes IS DISTINCT FROM c.bytes),
k AS (SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now_ IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(was, 0) AS before, coalesce(now_, 0) AS after,
        CASE WHEN was IS NULL THEN now_ WHEN now_ IS NULL THEN was ELSE now_ - was END AS weight FROM d)"""


@query("Q4_inventory_diff", f"""
WITH {_SNAPS} SELECT path, change, before, after, weight, row_number() OVER (PARTITION BY change ORDER BY weight DESC, path) AS rank
FROM k QUALIFY row_number() OVER (PARTITION BY change ORDER BY weight DESC, path) <= 20
""")
def inventory_diff(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("bytes"))
    b = d.where("doc_id % 5 <> 0").select("path", "bytes")
    c = d.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.col("bytes") + F.col("doc_id") % 11 - 5).otherwise(F.col("bytes")).alias("bytes"))
    return metrics.inventory_diff(b, c, 20)


@query("N2_recent_list", """
WITH o AS (SELECT user_id, props AS location, ts, event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 40)::BIGINT END AS page FROM events),
s AS (SELECT user_id, location, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS seq, coalesce(arg_max(page, (ts, event_id)) FILTER (page IS NOT NULL), 1) AS page FROM o GROUP BY ALL)
SELECT user_id, location, seq, page, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) <= 12
""")
def recent(spark, folder):
    e = table(spark, folder, "events")
    opened = e.select("user_id", F.col("props").alias("location"), F.col("ts").alias("opened_at"), F.col("event_id").alias("seq"),
                      F.when(F.pmod("event_id", F.lit(3)) == 0, F.pmod("event_id", F.lit(40))).alias("page"))
    return metrics.recent(opened).drop("opened_at")
