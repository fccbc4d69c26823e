"""Reading, normalising and writing bars, and the bookkeeping of incremental ingest."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.functions.columns import to_market_tz

PRICES = ("open", "high", "low", "close")


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_OHLCV = [(c, T.DoubleType()) for c in (*PRICES, "volume")]
BARS_5M = _schema(("ticker", T.StringType()), ("day", T.DateType()), ("ts", T.TimestampNTZType()), *_OHLCV, ("session", T.StringType()))
BARS_DAILY = _schema(("ticker", T.StringType()), ("day", T.DateType()), *_OHLCV)


def scan_bars(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Bars at a path with a fixed schema; no rows where the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Events as ticks of their type: ts in market time, price, volume 1, seq."""
    return events.select(F.col("event_type").alias("ticker"), to_market_tz(F.col("ts")).alias("ts"),
                         F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def ticks_from_lineitem(lineitem: DataFrame, ticker: str = "l_returnflag") -> DataFrame:
    """Line items as ticks of a column's values, at midnight of the ship date.

    seq orders the ticks of a day: order (14 digits), line (2), part (12) and supplier (10) in one decimal.
    """
    price, qty = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    seq = F.lit(Decimal(0)).cast("decimal(38,0)")
    for column, digits in (("l_orderkey", 14), ("l_linenumber", 2), ("l_partkey", 12), ("l_suppkey", 10)):
        seq = (seq * F.lit(Decimal(10**digits)) + F.col(column).cast("decimal(19,0)")).cast("decimal(38,0)")
    return lineitem.select(F.col(ticker).cast("string").alias("ticker"), F.col("l_shipdate").cast("date").cast("timestamp_ntz").alias("ts"),
                           (price / qty).alias("price"), qty.alias("volume"), seq.alias("seq"))


def unpivot_provider(raw: DataFrame, fields: Sequence[str] = ("Open", "High", "Low", "Close", "Volume")) -> DataFrame:
    """Wide provider columns `Field|SYMBOL` as one row a symbol and time: Date, symbol and a column a field."""
    symbols = sorted({c.split("|", 1)[1] for c in raw.columns if "|" in c})
    rows = [F.struct(F.lit(s).alias("symbol"), *[(F.col(f"`{f}|{s}`") if f"{f}|{s}" in raw.columns else F.lit(None)).cast("string").alias(f) for f in fields]) for s in symbols]
    return raw.select(raw.columns[0], F.explode(F.array(*rows)).alias("r")).select(raw.columns[0], "r.*")


def normalize_bars(raw: DataFrame, kind: str = "daily", keep: Sequence[str] = ()) -> DataFrame:
    """Provider columns to canonical ones: Date, Datetime or the first column is the time, prices become numbers.

    Rows without a time or a price go. kind "daily" gives day, "5m" gives ts (UTC to market time) and day.
    """
    lower = {c.lower(): c for c in raw.columns if c not in keep}
    when = next((lower[c] for c in ("date", "datetime") if c in lower), raw.columns[0])
    number = lambda c: F.col(f"`{lower[c]}`").cast("string").try_cast("double") if c in lower else F.lit(None).cast("double")
    at = F.col(f"`{when}`").cast("string").try_cast("timestamp_ntz")
    time = [at.cast("date").alias("day")] if kind == "daily" else [to_market_tz(at).alias("ts"), to_market_tz(at).cast("date").alias("day")]
    out = raw.select(*keep, *time, *[F.nanvl(number(c), F.lit(None).cast("double")).alias(c) for c in (*PRICES, "volume")])
    return out.dropna(subset=["day" if kind == "daily" else "ts", *PRICES])


def clean_symbol(symbol: Column) -> Column:
    return F.ltrim(F.trim(symbol), F.lit("$"))


def with_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds ticker and kind by the cleaned provider symbol; rows of unknown symbols go."""
    u = universe.select("ticker", "kind", clean_symbol(F.col("provider_symbol")).alias("_symbol"))
    return df.withColumn("_symbol", clean_symbol(F.col("symbol"))).join(u, "_symbol").drop("_symbol")


def ingest_start(existing: DataFrame, universe: DataFrame, buffer: str, default: str) -> DataFrame:
    """ticker, start: the newest stored time less the buffer (as "7 days"), else the default."""
    newest = existing.groupBy("ticker").agg(F.max("ts").alias("last_ts"))
    start = F.coalesce(F.col("last_ts") - F.expr(f"INTERVAL {buffer}"), F.lit(default).cast("timestamp_ntz"))
    return universe.select("ticker").distinct().join(newest, "ticker", "left").select("ticker", "last_ts", start.alias("start"))


def expand_lookback(universe: DataFrame, day: Column, n: int) -> DataFrame:
    """Each ticker with the day and the n days before it."""
    back = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("back")
    return universe.select("ticker", day.alias("_day"), back).select("ticker", F.date_sub("_day", F.col("back")).alias("day"))


def ingest_audit(before: DataFrame, fetched: DataFrame, after: DataFrame) -> DataFrame:
    """rows_before, rows_fetched, rows_after and last_ts of each ticker in any of the three."""
    count = lambda df, name: df.groupBy("ticker").agg(F.count("*").alias(name))
    out = count(before, "rows_before").join(count(fetched, "rows_fetched"), "ticker", "full").join(
        after.groupBy("ticker").agg(F.count("*").alias("rows_after"), F.max("ts").alias("last_ts")), "ticker", "full")
    return out.select("ticker", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_before", "rows_fetched", "rows_after")], "last_ts")


def write_bars(df: DataFrame, path: str, file_rows: int = 4_000_000) -> None:
    """Replaces the days that df has, and no others, in a table partitioned by day.

    Rows are dealt by ranges of day, ticker and time and sorted, so a day of many rows is written by many tasks, files have
    at most `file_rows` rows, and a filter on a ticker skips the row groups of others.
    """
    keys = [c for c in ("day", "ticker", "ts") if c in df.columns]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "maxRecordsPerFile", file_rows).partitionBy("day").parquet(path)


def latest_by_ticker(df: DataFrame, order: str = "day") -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines to their day's folder."""
    df.write.mode("append").partitionBy("day").json(path)


def scan_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def apply_retention(bars: DataFrame, as_of: Column, days: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of the last `days` days, and how many (ticker, day) parts went; zero or None keeps all."""
    limit = F.date_sub(as_of, days) if days and days > 0 else F.lit("0001-01-01").cast("date")
    gone = bars.where(F.col("day") < limit).select("ticker", "day").distinct().agg(F.count("*").alias("deleted"))
    return bars.where(F.col("day") >= limit), gone


def asof_partition(df: DataFrame, day: Column) -> DataFrame:
    """Each ticker's rows of its newest day up to the requested one."""
    upto = df.where(F.col("day") <= day)
    return upto.join(upto.groupBy("ticker").agg(F.max("day").alias("day")), ["ticker", "day"])
