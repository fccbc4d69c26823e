"""Sinks of streams that a retried batch does not write twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a folder a batch, named by its number and replaced as a whole, so that a batch which failed
    between its write and its commit leaves one copy of its rows when it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return write


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a batch_sink(), with the number of their batch (_batch)."""
    return spark.read.parquet(path)


def newest_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the rows of its newest batch: what a stream of updates stands at."""
    newest = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return rows.join(newest, [*keys, "_batch"]).drop("_batch")
