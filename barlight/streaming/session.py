"""Structured Streaming forms of the session operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlight.functions.columns import SESSIONS, label_session, trading_day
from barlight.operators.clean import order_key

LATE = "60 minutes"
#: How long the state of a ticker's day is kept behind the newest bar of all.
BEHIND, BEHIND_MS = "3 days", 3 * 86_400_000


def _timed(df: DataFrame) -> DataFrame:
    """Watermarks need instants: the local time read in the session's zone, and written back in it."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def _local(column: str):
    return F.col(column).cast("timestamp_ntz")


def stream_dedupe(bars: DataFrame) -> DataFrame:
    """One bar a ticker and time within the watermark; unlike the batch merge, the first arrival wins."""
    return _timed(bars).dropDuplicatesWithinWatermark(["ticker", "ts"]).withColumn("ts", _local("ts"))


def stream_bars(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Tumbling bars of a tick stream, each emitted once the watermark has passed its end."""
    order = order_key(F.col("ts"), F.col("seq"))
    bars = _timed(ticks).groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("ticker", _local("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def _folded(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One ticker's day: bars after its newest one, in order of time, go into its state; sessions that changed come out."""
    if state.hasTimedOut:
        state.remove()
        return
    newest, own = (state.get[0], [list(x) for x in zip(*state.get[1:], strict=True)]) if state.exists else (None, [[None, None, None, 0, 0.0, 0.0] for _ in SESSIONS])
    rows = pd.concat(list(parts)).sort_values("at", kind="stable").drop_duplicates("at")
    rows = rows if newest is None else rows[rows["at"] > newest]
    changed = []
    for i, name in enumerate(SESSIONS):
        part = rows[rows["session"] == name]
        if len(part):
            high, low, last, bars, pv, v = own[i]
            best = lambda x, y, f: f([float(z) for z in (x, y) if z is not None and z == z], default=None)
            close = part["close"].iloc[-1]
            volume = part["volume"].fillna(0.0)
            if name == "RTH":
                pv, v = pv + float(((part["high"] + part["low"] + part["close"]) / 3.0 * volume).sum()), v + float(volume.sum())
            own[i] = [best(high, part["high"].max(), max), best(low, part["low"].min(), min), last if pd.isna(close) else float(close), bars + len(part), pv, v]
            changed.append((name, *own[i][:4], pv / v if v > 0 else None))
    if changed:
        state.update((int(rows["at"].iloc[-1]), *(list(x) for x in zip(*own, strict=True))))
    day_end = int(pd.Timestamp(key[1]).timestamp() * 1000) + 86_400_000 + BEHIND_MS
    state.setTimeoutTimestamp(max(day_end, state.getCurrentWatermarkMs() + 1))
    if changed:
        out = pd.DataFrame(changed, columns=["session", "high", "low", "close", "bar_count", "vwap"])
        out.insert(0, "day", key[1])
        out.insert(0, "ticker", key[0])
        yield out


def stream_session_state(bars: DataFrame) -> DataFrame:
    """session_agg() and VWAP of arriving bars, updated with each batch.

    The cutoff is a ticker's own: within a batch bars count in order of time, and a bar at or before the newest one that
    its ticker's day has is ignored, as merge_state() does batch by batch. One ticker's delay costs another nothing. A day's
    state goes once the newest bar of all is three days past its end; a bar that is so late is ignored.
    """
    c = F.col
    own = bars.withColumn("session", label_session(c("ts"))).where(c("session").isin(*SESSIONS))
    instant = c("ts").cast("timestamp")
    rows = own.select("ticker", trading_day(c("ts")).alias("day"), "session", "high", "low", "close", "volume", F.unix_micros(instant).alias("at"), instant.alias("ts"))
    return rows.withWatermark("ts", BEHIND).groupBy("ticker", "day").applyInPandasWithState(
        _folded, "ticker string, day date, session string, high double, low double, close double, bar_count long, vwap double",
        "at long, high array<double>, low array<double>, close array<double>, bars array<long>, pv array<double>, v array<double>", "update", GroupStateTimeout.EventTimeTimeout)
