"""Rolling features of bars. Daily features share one window, so a ticker's rows are shuffled and sorted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlight.functions.columns import ratio
from barlight.operators.levels import true_range
from barlight.sources.bars import latest_by_ticker

MIN_ROWS = 60
#: Bars of a block of intraday features, up to a day more: some 70 days of a ticker that trades all session.
BLOCK_BARS = 10_000


def _full(value: Column, over: Column, w: WindowSpec, n: int) -> Column:
    """value over a window that has n non-null inputs, else null."""
    return F.when(F.count(over).over(w) == n, value.over(w))


def log_return(order: WindowSpec) -> Column:
    """Log of a close by the one before; null where either is missing or not above 0."""
    before = F.lag("close").over(order)
    return F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before))


def rv(order: WindowSpec, n: int) -> Column:
    """Sample deviation of the last n log returns (column _ret)."""
    return _full(F.stddev_samp("_ret"), F.col("_ret"), order.rowsBetween(-(n - 1), 0), n)


def efficiency_ratio(order: WindowSpec, n: int) -> Column:
    """Net change over n bars by the sum of their changes (column _step)."""
    net = F.abs(F.col("close") - F.lag("close", n).over(order))
    return ratio(net, _full(F.sum("_step"), F.col("_step"), order.rowsBetween(-(n - 1), 0), n))


def day_blocks(bars: DataFrame, halo: int, size: int) -> DataFrame:
    """ticker, day, block and blocks of each day with bars: blocks are runs of whole days of about `size` bars, and
    `blocks` holds the day's own and each later one whose first bar has a bar of the day among the `halo` before it."""
    order = Window.partitionBy("ticker").orderBy("day")
    days = bars.groupBy("ticker", "day").agg(F.count("*").alias("n"))
    days = days.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("block", F.floor((F.col("end") - F.col("n")) / size)).withColumn("next", F.lead("block").over(order))
    ahead = Window.partitionBy("ticker").orderBy("end").rangeBetween(0, halo - 1)
    return days.select("ticker", "day", "block", F.array_distinct(F.concat(F.array("block"), F.collect_set("next").over(ahead))).alias("blocks"))


def intraday_features(bars: DataFrame, context: DataFrame, n: int = 12, block: int = BLOCK_BARS) -> DataFrame:
    """Bars with rv, er, overlap, dist_vwap_atr and pos_rth_range; context: ticker, day, atr, rth_vwap, rth_high, rth_low.

    A ticker's history is dealt out in blocks of days, each with the n bars before it, so that it is many tasks.
    """
    days = day_blocks(bars, n, block).select(F.col("ticker").alias("_t"), F.col("day").alias("_d"), F.col("block").alias("_own"), "blocks")
    dealt = bars.join(days, bars.ticker.eqNullSafe(F.col("_t")) & bars.day.eqNullSafe(F.col("_d"))).drop("_t", "_d")
    dealt = dealt.withColumn("_block", F.explode("blocks")).drop("blocks")
    order = Window.partitionBy("ticker", "_block").orderBy("ts")
    prev_high, prev_low = F.lag("high").over(order), F.lag("low").over(order)
    shared = F.greatest(F.least("high", prev_high) - F.greatest("low", prev_low), F.lit(0.0))
    union = F.greatest("high", prev_high) - F.least("low", prev_low)
    out = dealt.withColumns({"_ret": log_return(order), "_step": F.abs(F.col("close") - F.lag("close").over(order)),
                             "_share": F.when(prev_high.isNotNull(), F.coalesce(ratio(shared, union), F.lit(0.0)))})
    w = order.rowsBetween(-(n - 1), 0)
    out = out.withColumns({"rv": rv(order, n), "er": efficiency_ratio(order, n), "overlap": _full(F.avg("_share"), F.col("_share"), w, n)})
    out = out.where(F.col("_block") == F.col("_own")).drop("_ret", "_step", "_share", "_block", "_own").join(context, ["ticker", "day"], "left")
    return out.withColumns({"dist_vwap_atr": ratio(F.col("close") - F.col("rth_vwap"), F.col("atr")),
                            "pos_rth_range": ratio(F.col("close") - F.col("rth_low"), F.col("rth_high") - F.col("rth_low"))})


def level_pressure(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Strength of levels within one ATR, falling with distance: those above less those below, a row a bar."""
    l = levels.select("ticker", "day", "price", "strength", "atr")  # noqa: E741
    pull = F.col("strength") * (1 - F.abs(F.col("price") - F.col("close")) / F.col("atr"))
    near = bars.select("ticker", "day", "ts", "close").join(l, ["ticker", "day"]).where(F.abs(F.col("price") - F.col("close")) <= F.col("atr"))
    return near.groupBy("ticker", "day", "ts").agg(F.sum(F.when(F.col("price") > F.col("close"), pull).otherwise(-pull)).alias("pressure"))


def features_5m_latest(features: DataFrame) -> DataFrame:
    """The newest row of each ticker and day: asof_ts, last_price, session and the features."""
    w = Window.partitionBy("ticker", "day").orderBy(F.desc("ts"))
    last = features.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return last.select("ticker", "day", F.col("ts").alias("asof_ts"), F.col("close").alias("last_price"), "session", "rv", "er", "overlap", "dist_vwap_atr", "pos_rth_range")


def daily_features(daily: DataFrame, n: int = 20, min_rows: int = MIN_ROWS) -> DataFrame:
    """daily with atr, rv, er, slope_close, pos_hhll, vol_z, range_atr and gap_atr, for tickers with enough rows."""
    order = Window.partitionBy("ticker").orderBy("day")
    w, w14 = order.rowsBetween(-(n - 1), 0), order.rowsBetween(-13, 0)
    out = daily.withColumns({"_tr": true_range(), "_ret": log_return(order), "_step": F.abs(F.col("close") - F.lag("close").over(order)),
                             "_prev": F.lag("close").over(order), "_idx": F.row_number().over(order).cast("double")})
    low, high = _full(F.min("low"), F.col("low"), w, n), _full(F.max("high"), F.col("high"), w, n)
    out = out.withColumns({"atr": _full(F.avg("_tr"), F.col("_tr"), w14, 14), "rv": rv(order, n), "er": efficiency_ratio(order, n),
                           "slope_close": _full(F.regr_slope("close", "_idx"), F.col("close"), w, n), "_ll": low, "_hh": high,
                           "vol_z": ratio(F.col("volume") - _full(F.avg("volume"), F.col("volume"), w, n), _full(F.stddev_samp("volume"), F.col("volume"), w, n)),
                           "_rows": F.count("*").over(Window.partitionBy("ticker"))})
    out = out.withColumns({"pos_hhll": ratio(F.col("close") - F.col("_ll"), F.col("_hh") - F.col("_ll")), "range_atr": ratio(F.col("high") - F.col("low"), F.col("atr")),
                           "gap_atr": ratio(F.col("open") - F.col("_prev"), F.col("atr"))})
    return out.where(F.col("_rows") >= min_rows).select(*daily.columns, "atr", "rv", "er", "slope_close", "pos_hhll", "vol_z", "range_atr", "gap_atr")


def features_daily_latest(features: DataFrame) -> DataFrame:
    return latest_by_ticker(features)
