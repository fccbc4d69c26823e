"""Session state: aggregates, VWAP, opening range, and folding new bars into stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.columns import RTH_OPEN, SESSIONS, seconds_of_day, typical_price, zero_as_missing

KEYS = ("ticker", "day", "session")


def _pv() -> Column:
    return typical_price(F.col("high"), F.col("low"), F.col("close")) * F.coalesce("volume", F.lit(0.0))


def _vwap(sum_pv: Column, sum_v: Column) -> Column:
    return F.when(sum_v > 0, sum_pv / sum_v)


def session_agg(bars: DataFrame, vwap_sessions: tuple = ("RTH",)) -> DataFrame:
    """high, low, close, bar_count, first_ts, last_ts, sum_pv, sum_v and vwap of each ticker, day and session.

    Bars outside the sessions are passed over; VWAP only accrues in the sessions named.
    """
    counted = F.col("session").isin(*vwap_sessions)
    out = bars.where(F.col("session").isin(*SESSIONS)).groupBy(*KEYS).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.count("*").alias("bar_count"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(F.when(counted, _pv()).otherwise(0.0)).alias("sum_pv"), F.sum(F.when(counted, F.coalesce("volume", F.lit(0.0))).otherwise(0.0)).alias("sum_v"))
    return out.withColumn("vwap", _vwap(F.col("sum_pv"), F.col("sum_v")))


def session_vwap(bars: DataFrame, sessions: tuple = ("RTH",)) -> DataFrame:
    return session_agg(bars, sessions).where(F.col("session").isin(*sessions)).select(*KEYS, "sum_pv", "sum_v", "vwap")


def running_vwap(bars: DataFrame) -> DataFrame:
    """Bars with the VWAP of their session so far."""
    w = Window.partitionBy(*KEYS).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("running_vwap", _vwap(F.sum(_pv()).over(w), F.sum(F.coalesce("volume", F.lit(0.0))).over(w)))


def opening_range(bars: DataFrame, minutes: int = 30, bar_minutes: int = 5) -> DataFrame:
    """High and low of the first minutes of RTH, and whether its last bar has come."""
    s = seconds_of_day(F.col("ts"))
    inside = bars.where((F.col("session") == "RTH") & (s >= RTH_OPEN) & (s < RTH_OPEN + 60 * minutes))
    start = F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL {RTH_OPEN} SECONDS")
    end = F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL {RTH_OPEN + 60 * minutes} SECONDS")
    out = inside.groupBy("ticker", "day").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("ts").alias("last_ts"))
    return out.select("ticker", "day", F.lit(minutes).alias("minutes"), start.alias("start_ts"), end.alias("end_ts"), "high", "low",
                      (F.col("last_ts") >= end - F.expr(f"INTERVAL {bar_minutes} MINUTES")).alias("complete"))


def session_state(agg: DataFrame) -> DataFrame:
    """One row a ticker and day with the columns of all three sessions, null or 0 bars where one is absent."""
    wide = agg.groupBy("ticker", "day").pivot("session", list(SESSIONS)).agg(
        F.first("high").alias("high"), F.first("low").alias("low"), F.first("close").alias("close"), F.first("bar_count").alias("bar_count"), F.first("vwap").alias("vwap"))
    return wide.select("ticker", "day", *[
        (F.coalesce(f"{s}_{c}", F.lit(0)) if c == "bar_count" else F.col(f"{s}_{c}")).alias(f"{s.lower()}_{c}") for s in SESSIONS for c in ("high", "low", "close", "bar_count", "vwap")])


def last_price(rth_close: Column, pre_close: Column) -> Column:
    """RTH close, else PRE close; zero counts as missing."""
    return F.coalesce(zero_as_missing(rth_close), zero_as_missing(pre_close))


def state_status(state: DataFrame, bars: DataFrame, day: Column) -> DataFrame:
    """init, no_data, up_to_date or updated of each ticker with state: state has ticker, day and last_update_ts."""
    fresh = state.select("ticker", F.when(F.col("day") == day, F.col("last_update_ts")).alias("last_update_ts"))
    own = bars.where(F.col("day") == day).join(fresh, "ticker").groupBy("ticker").agg(
        F.count("*").alias("bars"), F.count_if(F.col("last_update_ts").isNull() | (F.col("ts") > F.col("last_update_ts"))).alias("new_bars"))
    bars_, new = F.coalesce("bars", F.lit(0)), F.coalesce("new_bars", F.lit(0))
    status = (F.when((bars_ == 0) & F.col("last_update_ts").isNull(), "init").when(bars_ == 0, "no_data").when(new == 0, "up_to_date").otherwise("updated"))
    return fresh.join(own, "ticker", "left").select("ticker", bars_.alias("bars"), new.alias("new_bars"), status.alias("status"))


def merge_state(state: DataFrame, bars: DataFrame) -> DataFrame:
    """Folds bars later than a ticker's newest stored one of the day into session_agg() state; older ones are ignored."""
    newest = state.groupBy("ticker", "day").agg(F.max("last_ts").alias("_upto"))
    new = session_agg(bars.join(newest, ["ticker", "day"], "left").where(F.col("_upto").isNull() | (F.col("ts") > F.col("_upto"))).drop("_upto"))
    n = new.select(*KEYS, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in KEYS])
    both = state.join(n, list(KEYS), "full")
    add = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"n_{c}", F.lit(0))
    out = both.select(*KEYS, F.greatest("high", "n_high").alias("high"), F.least("low", "n_low").alias("low"), F.coalesce("n_close", "close").alias("close"),
                      add("bar_count").alias("bar_count"), F.least("first_ts", "n_first_ts").alias("first_ts"), F.greatest("last_ts", "n_last_ts").alias("last_ts"),
                      add("sum_pv").alias("sum_pv"), add("sum_v").alias("sum_v"))
    return out.withColumn("vwap", _vwap(F.col("sum_pv"), F.col("sum_v")))
