"""Nightly runs: a new day's features from that day's rows and the last rows of each ticker, not from its history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.operators import features, levels
from barlight.sources.bars import BARS_DAILY, scan_bars, write_bars

#: Rows before a new one that its features look at: 20 and the one before them; pivots see 120 bars and 2 on either side.
FEATURE_ROWS, PIVOT_ROWS = 21, 125

Run = Callable[[DataFrame, DataFrame], DataFrame]


def feature_run(rows: DataFrame, days: DataFrame) -> DataFrame:
    return features.daily_features(rows, min_rows=1).join(days, ["ticker", "day"], "left_semi")


def pivot_run(rows: DataFrame, days: DataFrame) -> DataFrame:
    return levels.swing_pivots(rows, days)


def last_tail(spark: SparkSession, tail: str, before: str) -> DataFrame | None:
    """The tail that the newest run before a day left: each ticker's last bars, and how many it has had (rows)."""
    try:
        found = spark.read.parquet(tail).where(F.col("asof") < F.lit(before).cast("date"))
    except Exception as e:  # no run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    newest = found.agg(F.max("asof")).first()[0]
    return None if newest is None else found.where(F.col("asof") == F.lit(newest)).drop("asof")


def _leave(every: DataFrame, tail: str, day: str, rows: int) -> None:
    last = Window.partitionBy("ticker").orderBy(F.desc("day"))
    kept = every.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= rows).drop("_n").withColumn("asof", F.lit(day).cast("date"))
    kept.repartition("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asof").parquet(tail)


def leave_tail(history: DataFrame, tail: str, day: str, rows: int = FEATURE_ROWS) -> None:
    """The tail of a history that ends on a day, from which nightly runs go on."""
    _leave(history.withColumn("rows", F.count("*").over(Window.partitionBy("ticker"))), tail, day, rows)


def nightly(spark: SparkSession, daily: str, out: str, tail: str, day: str, run: Run = feature_run, rows: int = FEATURE_ROWS, min_rows: int = 1) -> DataFrame:
    """Runs one day: reads its partition of the daily bars and the last tail, replaces its partition of out, and leaves a
    tail for the next day. Returns the bars that were read from the daily table.

    A ticker without a bar that day keeps its tail, so gaps change nothing. A ticker's results begin once it has had
    min_rows bars. A day may be run again, and gives the same; days are run in order.
    """
    new = scan_bars(spark, daily, BARS_DAILY).where(F.col("day") == F.lit(day).cast("date"))
    old = last_tail(spark, tail, day)
    fresh = new.withColumn("rows", F.lit(0).cast("long"))
    every = fresh if old is None else old.select(*fresh.columns).unionByName(fresh)
    by_ticker = Window.partitionBy("ticker")
    every = every.withColumn("rows", F.max("rows").over(by_ticker) + F.max(F.when(F.col("day") == F.lit(day).cast("date"), 1).otherwise(0)).over(by_ticker))
    known = every.where((F.col("day") == F.lit(day).cast("date")) & (F.col("rows") >= min_rows)).select("ticker", "day")
    write_bars(run(every.drop("rows"), known), out)
    _leave(every, tail, day, rows)
    return new


def features_schema() -> T.StructType:
    names = ("atr", "rv", "er", "slope_close", "pos_hhll", "vol_z", "range_atr", "gap_atr")
    return T.StructType([*BARS_DAILY.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
