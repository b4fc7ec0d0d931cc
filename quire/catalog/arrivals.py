"""Incremental forms (N): the given tables read as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.catalog.base import query, table
from quire.catalog.linkage import ITEMS
from quire.plans.checkpoints import ensure_folder, new_folder
from quire.operators import links
from quire.streaming import arrivals


def _folder(spark) -> str:
    """A fresh folder under the shared checkpoint folder."""
    ensure_folder(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark, folder: str, name: str):
    schema = table(spark, folder, name).schema
    # A pattern, as a stream's plain path may not be a single file; it matches a table that is a file or a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.[p]arquet")


@query("N1_inspect_on_arrival", f"WITH {ITEMS} SELECT * FROM report")
def inspect(spark, folder):
    place = _folder(spark)
    pages = _stream(spark, folder, "pages").select(
        F.floor(F.col("page_id") / 60).alias("doc_id"), (F.pmod("page_id", F.lit(60)) + 1).alias("page_no"), "url", "html")
    arrivals.inspect_stream(pages, place, f"{place}-state", links.MAX_DETAILS, links.MAX_PAGES).awaitTermination()
    return arrivals.findings_so_far(spark, place).withColumn("details", F.array_join("details", " | "))


@query("N2_recent_stream", """
WITH s AS (SELECT user_id, props AS location, arg_max(event_id, (ts, event_id)) AS seq, max(ts) AS ts, (arg_max(event_id, (ts, event_id)) % 40 + 1)::BIGINT AS page FROM events GROUP BY ALL)
SELECT user_id, location, seq, page, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) <= 12
""")
def recent_stream(spark, folder):
    """Recent lists of users as events arrive in five batches."""
    place = new_folder(spark, "recent")
    rows = table(spark, folder, "events").select(
        "user_id", F.col("props").alias("location"), F.col("ts").cast("timestamp").alias("opened_at"), F.col("event_id").cast("long").alias("seq"), (F.pmod("event_id", F.lit(40)) + 1).cast("long").alias("page"))
    rows.repartition(40, "seq").write.parquet(f"{place}/in")
    opened = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{place}/in")
    arrivals.recent_stream(opened, f"{place}/out", f"{place}/state").awaitTermination()
    return arrivals.recent_so_far(spark, f"{place}/out").drop("opened_at")


@query("N3_pages_once", """
SELECT user_id AS doc_id, count(DISTINCT event_id % 20) AS pages FROM events GROUP BY user_id
""")
def pages_once(spark, folder):
    """Pages per document, each counted once however often it is reported."""
    place = _folder(spark)
    events = _stream(spark, folder, "events")
    rows = events.select(
        F.col("user_id").alias("doc_id"), (F.pmod("event_id", F.lit(20)) + 1).alias("page_no"), F.col("ts").cast("timestamp").alias("ts"),
        F.array().cast("array<string>").alias("reasons"), F.least(F.col("value") / 500, F.lit(1.0)).alias("fallback_area"))
    arrivals.first_pages_stream(rows, place, f"{place}-state", "400 days").awaitTermination()
    return arrivals.coverage_so_far(spark, place).select("doc_id", "pages")


