"""The register of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the same computation in SQL where SQL can say it."""

    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, folder: plain(run(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


SPREAD_OVER = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores, dealt out to all of them once.

    A file of one row group is one task however many cores wait; a table in many files is left as it is
    read. Filters and column choices still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_OVER or size > cores * (128 << 20) or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and other numbers as double, so both engines show the same types."""
    columns = []
    for field in df.schema.fields:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint").alias(field.name)
        elif isinstance(kind, (T.FloatType, T.DecimalType)):
            column = column.cast("double").alias(field.name)
        columns.append(column)
    return df.select(*columns)
