"""Incremental forms: inspection of new documents, recent lists, and pages counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import links, metrics


def _there(df: DataFrame, path: str) -> bool:
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(hadoop)


def inspect_stream(pages: DataFrame, sink: str, checkpoint: str, max_details: int | None = None, max_pages: int | None = None) -> StreamingQuery:
    """Safety findings of every document as its pages `(doc_id, page_no, url, html)` arrive, each page counted once.

    Items are kept by page, and a document that got new pages has its report made again from all its items. A batch
    writes its own folders, so one that runs again after a failure replaces what it wrote. `findings_so_far` reads them.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates(["doc_id", "page_no"])
        if _there(batch, f"{sink}/seen"):
            known = spark.read.parquet(f"{sink}/seen").where(F.col("batch") < number).select("doc_id", "page_no")
            new = new.join(known, ["doc_id", "page_no"], "left_anti")
        new.select("doc_id", "page_no").write.mode("overwrite").parquet(f"{sink}/seen/batch={number}")
        links.active_items(new).write.mode("overwrite").parquet(f"{sink}/items/batch={number}")
        changed = spark.read.parquet(f"{sink}/seen/batch={number}").select("doc_id").distinct()
        items = spark.read.parquet(f"{sink}/items").where(F.col("batch") <= number).drop("batch").join(changed, "doc_id", "left_semi")
        links.safety_report(items, max_details, max_pages).write.mode("overwrite").parquet(f"{sink}/findings/batch={number}")

    return pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_so_far(spark: SparkSession, sink: str) -> DataFrame:
    """The last report of every document that has findings."""
    found = spark.read.parquet(f"{sink}/findings")
    last = found.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return found.join(last, ["doc_id", "batch"], "left_semi").drop("batch")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Every so many batches all lists are written again, so that a batch never reads more than those since.
WHOLE_EVERY = 16


def _newest(rows: DataFrame, capacity: int) -> DataFrame:
    """The lists that entries `(user_id, location, opened_at, seq, page, _new)` make, without more than one entry of a location."""
    at = F.struct("opened_at", "seq", "_new")
    # Without page an entry takes the last one known.
    last = rows.groupBy("user_id", "location").agg(
        F.max(at).alias("_at"), F.coalesce(F.max_by("page", F.when(F.col("page").isNotNull(), at)), F.lit(1)).alias("page"))
    newest = W.partitionBy("user_id").orderBy(F.desc("_at.opened_at"), F.desc("_at.seq"), F.desc("location"))
    ranked = last.withColumn("rank", F.row_number().over(newest).cast("long")).where(F.col("rank") <= capacity)
    return ranked.select("user_id", "location", F.col("_at.opened_at").alias("opened_at"), F.col("_at.seq").alias("seq"), "page", "rank")


def recent_stream(opened: DataFrame, sink: str, checkpoint: str, capacity: int = 12) -> StreamingQuery:
    """Recent lists of users as documents `(user_id, location, opened_at, seq, page)` are opened, one bounded list per user;
    `recent_so_far` reads them.

    A batch puts its rows to the lists the batches before it left, and writes the lists of the users it met to a folder of its
    own, so one that runs again after a failure replaces what it wrote; every sixteenth writes all lists. A page not given is the entry's
    last one; an entry that fell off the list has none. Rows that come late count by their own time.
    """

    def store(batch: DataFrame, number: int) -> None:
        new = batch.select("user_id", "location", "opened_at", F.col("seq").cast("long").alias("seq"), F.col("page").cast("long").alias("page"), F.lit(True).alias("_new"))
        if number and _there(batch, sink):
            known = _last_lists(batch.sparkSession, sink, number).drop("rank").withColumn("_new", F.lit(False))
            if number % WHOLE_EVERY:
                met = new.select(F.col("user_id").alias("_met")).distinct()
                known = known.join(met, F.col("user_id").eqNullSafe(F.col("_met")), "left_semi")
            new = known.unionByName(new)
        _newest(new, capacity).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return opened.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last_lists(spark: SparkSession, sink: str, before: int) -> DataFrame:
    """The last list of every user that the batches before a number left."""
    lists = spark.read.parquet(sink).where((F.col("batch") >= (before - 1) // WHOLE_EVERY * WHOLE_EVERY) & (F.col("batch") < before))
    last = F.max("batch").over(W.partitionBy("user_id"))
    return lists.withColumn("_last", last).where("batch = _last").drop("batch", "_last")


def recent_so_far(spark: SparkSession, sink: str) -> DataFrame:
    """The last list of every user."""
    newest = spark.read.parquet(sink).agg(F.max("batch")).first()[0]
    return _last_lists(spark, sink, 0 if newest is None else newest + 1)


def first_pages_stream(pages: DataFrame, sink: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """The first record of each page `(doc_id, page_no, ts, …)`, so that repeats do not count again.

    The watermark bounds what is remembered: repeats are recognised within it.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    once = pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "page_no"])
    return once.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_so_far(spark, sink: str) -> DataFrame:
    """Coverage over the pages stored until now."""
    return metrics.coverage(spark.read.parquet(sink), ["doc_id"])
