"""Cleaning, rolling up and validating bars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.functions.columns import label_session, safe_float, to_market_tz, trading_day

PRICES = ("open", "high", "low", "close")


def merge_dedupe(existing: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a ticker and time of both inputs: new rows win, among them the last by seq."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    w = Window.partitionBy("ticker", "ts").orderBy(F.desc("_src"), F.desc(seq))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_src")


def last_timestamp(df: DataFrame) -> DataFrame:
    """Newest time of each ticker in market time; strings that are no time are passed over."""
    return df.groupBy("ticker").agg(to_market_tz(F.max(F.col("ts").cast("string").try_cast("timestamp_ntz"))).alias("last_ts"))


def order_key(ts: Column, seq: Column) -> Column:
    """Time, then a whole-number seq, in one decimal, so that a hash aggregate can hold it and no tick is sorted.

    A missing time or seq comes first. Microseconds have 17 digits in any calendar year, seq has 19 and a sign.
    """
    micros = F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(-(10**17))).cast("decimal(18,0)")
    return (micros * F.lit(Decimal(10**20)) + F.coalesce(seq, F.lit(-(2**63))).cast("decimal(19,0)")).cast("decimal(38,0)")


def _numeric(df: DataFrame) -> bool:
    return all(isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) for f in df.schema)


def floor_grid(df: DataFrame, width: str = "5 minutes", seq: str = "seq") -> DataFrame:
    """Times floored to a grid, one row a ticker and grid time: the last by its own time, then seq.

    Rows of numbers are hash-aggregated column by column; others carry the row in a struct. Neither needs a window over
    all rows.
    """
    key, rest = order_key(F.col("ts"), F.col(seq)), [c for c in df.columns if c not in ("ticker", "ts")]
    keyed = df.withColumns({"_grid": F.window("ts", width)["start"].cast("timestamp_ntz"), "_key": key}).groupBy("ticker", F.col("_grid"))
    if _numeric(df.select(*rest)):
        out = keyed.agg(*[F.max_by(c, "_key").alias(c) for c in rest])
    else:
        out = keyed.agg(F.max_by(F.struct(*rest), "_key").alias("_row")).select("ticker", "_grid", "_row.*")
    return out.withColumnRenamed("_grid", "ts").select(*[c for c in df.columns if c != "ts"], "ts")


def build_bars(ticks: DataFrame, width: str = "5 minutes", order: Column | None = None) -> DataFrame:
    """OHLCV bars of ticks (ticker, ts in market time, price, volume, seq); "1 day" gives a row a local day.

    order: one number that orders the ticks of a bar, by default order_key() of ts and a whole-number seq. Every part of
    the aggregate is a number, so ticks are hashed on both sides of the shuffle and never sorted.
    """
    order = order_key(F.col("ts"), F.col("seq")) if order is None else order
    sums = [F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")]
    if width == "1 day":
        return ticks.groupBy("ticker", trading_day(F.col("ts")).alias("day")).agg(*sums)
    start = F.window("ts", width)["start"].cast("timestamp_ntz")
    # the label is taken from an aggregate, so that a filter on it runs once a bar and isn't pushed down to every tick
    bars = ticks.groupBy("ticker", start.alias("ts")).agg(*sums, F.min(start).alias("_start"))
    return bars.select("ticker", trading_day(F.col("ts")).alias("day"), "ts", *PRICES, "volume", label_session(F.col("_start")).alias("session"))


def daily_of_bars(bars: DataFrame) -> DataFrame:
    """Daily bars of shorter ones that nest in local days, so that ticks are read once for both."""
    return bars.groupBy("ticker", "day").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def bad_ohlc():
    """True where high is below low, or open or close lie outside them."""
    c = F.col
    return (c("high") < c("low")) | (c("open") > c("high")) | (c("open") < c("low")) | (c("close") > c("high")) | (c("close") < c("low"))


def validation_report(df: DataFrame, seq: str = "seq", block: int = 1_000_000) -> DataFrame:
    """rows, monotonic_ts (in ingest order), duplicate_ts and bad_ohlc_rows of each ticker.

    Rows are looked at in blocks of seq, a whole number: a block is in order or not and has a first and a last time, and
    blocks are compared in turn, so a ticker's rows are as many tasks as it has blocks. Repeated times are counted by
    (ticker, time). A missing time breaks no order and is no repeat.
    """
    part = F.floor(F.col(seq) / block)
    inside = Window.partitionBy("ticker", "_part").orderBy(seq)
    rows = df.select("ticker", "ts", F.col(seq).alias(seq), part.alias("_part"), bad_ohlc().alias("_bad"))
    rows = rows.withColumns({"_ok": F.coalesce(F.col("ts") >= F.lag("ts").over(inside), F.lit(True)), "_n": F.row_number().over(inside)})
    blocks = rows.groupBy("ticker", "_part").agg(
        F.count("*").alias("rows"), F.min("_ok").alias("_ok"), F.min_by("ts", "_n").alias("_first"), F.max_by("ts", "_n").alias("_last"), F.count_if("_bad").alias("bad_ohlc_rows"))
    follows = F.coalesce(F.col("_first") >= F.lag("_last").over(Window.partitionBy("ticker").orderBy("_part")), F.lit(True))
    order = blocks.withColumn("_ok", F.col("_ok") & follows).groupBy("ticker").agg(F.sum("rows").alias("rows"), F.min("_ok").alias("monotonic_ts"), F.sum("bad_ohlc_rows").alias("bad_ohlc_rows"))
    times = df.groupBy("ticker", "ts").agg(F.count("ts").alias("_n"))
    again = times.groupBy(F.col("ticker").alias("_of")).agg(F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).alias("duplicate_ts"))
    return order.join(again, F.col("ticker").eqNullSafe(F.col("_of"))).select("ticker", "rows", "monotonic_ts", "duplicate_ts", "bad_ohlc_rows")


def split_valid(df: DataFrame, require_volume: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones with a reason."""
    missing = [c for c in ("ticker", "ts", *PRICES) if c not in df.columns]
    if missing or (require_volume and "volume" not in df.columns):
        raise ValueError(f"columns are missing: {missing or ['volume']}")
    reason = F.when(F.col("ts").isNull(), "no time").when(F.coalesce(bad_ohlc(), F.lit(True)), "bad prices")
    if require_volume:
        reason = reason.when(F.col("volume").isNull(), "no volume")
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def assert_valid(df: DataFrame, require_volume: bool = True) -> DataFrame:
    """df, failing on the first bad row when it runs; ValueError at once on missing columns or no rows."""
    _, bad = split_valid(df, require_volume)
    if df.isEmpty():
        raise ValueError("no rows")
    reason = F.when(F.col("ts").isNull() | F.coalesce(bad_ohlc(), F.lit(True)) | (F.lit(require_volume) & F.col("volume").isNull()),
                    F.raise_error(F.lit("bad bar"))).otherwise(True)
    return df.where(F.coalesce(reason.cast("boolean"), F.lit(True)))


def clean_daily(df: DataFrame) -> DataFrame:
    """Prices and volume as numbers (else null); rows without a day or a price go."""
    return df.withColumns({c: safe_float(F.col(c).cast("string")) for c in (*PRICES, "volume")}).dropna(subset=["day", *PRICES])
