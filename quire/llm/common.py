"""What the operators of this subpackage share: staging, row keys, chunks of text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code points worked on at a time inside a task; bounds its memory whatever the batch holds.
CHUNK = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without the setting gets a scratch one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh place under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read back: lineage ends here."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """`(doc_id, text)` and what else is asked for; a null text is the empty text. Other columns stay behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def row_key() -> Column:
    """One key for each (doc_id, text); rows that agree in both get the same results anyway."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo `divisor`; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


_SAFE = re.compile(r"[^\W\d_] [^\W\d_]")


def parts(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in runs of about `size`, cut only before a single blank between two letters."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(values: list[str], size: int = CHUNK) -> Iterator[tuple[int, int, list[str]]]:
    """(first, last + 1, texts): whole texts together up to `size`; a longer one comes in several chunks of its own."""
    first, held, total = 0, [], 0
    for i, text in enumerate(values):
        if held and total + len(text) > size:
            yield first, i, held
            first, held, total = i, [], 0
        if len(text) > size:
            for part in parts(text, size):
                yield i, i + 1, [part]
            first = i + 1
        else:
            held.append(text)
            total += len(text)
    if held:
        yield first, len(values), held
