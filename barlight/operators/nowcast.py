"""Nowcast of today's remaining range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.functions.columns import AFT_CLOSE, PRE_OPEN, RTH_CLOSE, RTH_OPEN, clamp01, ratio


@dataclass(frozen=True)
class NowcastParams:
    bars: int = 78
    bar_minutes: int = 5
    z68: float = 1.0
    z95: float = 1.96
    base: float = 0.35
    scale: float = 1.65
    power: float = 1.35
    atr_floor: float = 0.10
    mode: str = "variance"  # or "linear"


def _at(day: Column, seconds: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def infer_session(asof: Column, day: Column) -> Column:
    """PRE, RTH, AFT or UNK of a time against the bounds of the day."""
    at = lambda s: _at(day, F.lit(s))
    return (F.when((asof >= at(PRE_OPEN)) & (asof < at(RTH_OPEN)), "PRE").when((asof >= at(RTH_OPEN)) & (asof < at(RTH_CLOSE)), "RTH")
            .when((asof >= at(RTH_CLOSE)) & (asof < at(AFT_CLOSE)), "AFT").otherwise("UNK"))


def session_end(session: Column, day: Column) -> Column:
    return _at(day, F.when(session == "PRE", RTH_OPEN).when(session == "AFT", AFT_CLOSE).otherwise(RTH_CLOSE))


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 60e6


def bars_remaining(asof: Column, end: Column, minutes: int = 5) -> Column:
    return F.greatest(F.ceil(minutes_between(asof, end) / minutes), F.lit(0)).cast("long")


def ushape_weights(spark: SparkSession, p: NowcastParams = NowcastParams()) -> DataFrame:
    """bar_index, weight and remaining (share of the weight after the bar) of the bars of a session."""
    n = p.bars
    if n <= 1:
        return spark.range(1).select(F.lit(0).cast("long").alias("bar_index"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("remaining"))
    x = (F.col("id") + 0.5) / n
    out = spark.range(n).select(F.col("id").alias("bar_index"), (p.base + p.scale * F.pow(2 * F.abs(x - 0.5), F.lit(p.power))).alias("weight"))
    after = Window.orderBy("bar_index").rowsBetween(1, Window.unboundedFollowing)  # as many rows as a session has bars
    return out.withColumn("remaining", clamp01(F.coalesce(F.sum("weight").over(after), F.lit(0.0)) / F.sum("weight").over(Window.partitionBy())))


def remaining_var_frac(df: DataFrame, p: NowcastParams = NowcastParams()) -> DataFrame:
    """df (session, bars_remaining) with remaining_var_frac: by the U-shape in RTH, else in proportion."""
    index = F.greatest(F.least(F.lit(p.bars) - F.col("bars_remaining"), F.lit(p.bars - 1)), F.lit(0))
    dim = ushape_weights(df.sparkSession, p).select(F.col("bar_index").alias("_bar"), "remaining")
    out = df.withColumn("_index", index).join(F.broadcast(dim), F.col("_index") == F.col("_bar"), "left")
    flat = clamp01(F.col("bars_remaining") / F.lit(float(p.bars)))
    return out.withColumn("remaining_var_frac", F.when(F.col("session") == "RTH", F.col("remaining")).otherwise(flat)).drop("_index", "_bar", "remaining")


def sigma_intraday() -> Column:
    c = F.col
    return F.when((c("rv") > 0) & (c("bars_remaining") > 0), c("last_price") * c("rv") * F.sqrt("bars_remaining"))


def sigma_atr() -> Column:
    return F.when(F.col("atr") > 0, F.col("atr") * F.sqrt("remaining_var_frac"))


def blend_weight(p: NowcastParams = NowcastParams()) -> Column:
    """Share of the session's bars seen, from the RTH bar count, else from the clock in RTH."""
    seen = F.coalesce(F.col("rth_bar_count").cast("double"), F.when(F.col("session") == "RTH", F.lit(float(p.bars)) - F.col("bars_remaining")).when(F.col("session") == "AFT", F.lit(float(p.bars))).otherwise(0.0))
    return clamp01(seen / p.bars)


def blend_sigma(df: DataFrame, p: NowcastParams = NowcastParams()) -> DataFrame:
    """Adds sigma_pts and sigma_source; both null where neither source is there. Never below a share of the ATR."""
    a, b, w = F.col("sigma_intraday"), F.col("sigma_atr"), F.col("blend_weight")
    both = w * a + (1 - w) * b if p.mode == "linear" else F.sqrt(w * a * a + (1 - w) * b * b)
    sigma = F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))
    name = F.when(a.isNotNull() & b.isNotNull(), "blend_lin" if p.mode == "linear" else "blend_var").when(a.isNotNull(), "intraday_only").when(b.isNotNull(), "atr_only")
    return df.withColumn("sigma_pts", F.when(sigma.isNotNull(), F.greatest(sigma, F.when(F.col("atr") > 0, F.col("atr") * p.atr_floor)))).withColumn("sigma_source", name)


def band(center: Column, sigma: Column, z: float) -> tuple[Column, Column]:
    return center - z * sigma, center + z * sigma


def with_bands(df: DataFrame, p: NowcastParams = NowcastParams()) -> DataFrame:
    """Remaining bands and those of the whole day given the extremes so far (missing extremes don't bind)."""
    new = {}
    for name, z in (("68", p.z68), ("95", p.z95)):
        low, high = band(F.col("last_price"), F.col("sigma_pts"), z)
        new |= {f"rem_low_{name}": low, f"rem_high_{name}": high, f"rem_width_{name}": high - low}
        day_low, day_high = F.least("low_so_far", low), F.greatest("high_so_far", high)
        new |= {f"day_low_{name}": day_low, f"day_high_{name}": day_high, f"day_width_{name}": day_high - day_low}
    return df.withColumns(new)


def nowcast_inputs(latest: DataFrame, state: DataFrame, context: DataFrame) -> DataFrame:
    """The newest features of each ticker and day with its state and ATR, and the extremes of the current session."""
    own = state.select("ticker", "day", *[f"{s}_{c}" for s in ("pre", "rth", "aft") for c in ("high", "low")], F.col("rth_bar_count"))
    out = latest.join(own, ["ticker", "day"]).join(context.select("ticker", "day", "atr"), ["ticker", "day"], "left")
    pick = lambda c: F.coalesce(F.nullif(F.when(F.col("session") == "PRE", F.col(f"pre_{c}")).when(F.col("session") == "AFT", F.col(f"aft_{c}")).otherwise(F.col(f"rth_{c}")), F.lit(0.0)), F.nullif(F.col(f"rth_{c}"), F.lit(0.0)))
    return out.withColumns({"low_so_far": pick("low"), "high_so_far": pick("high")})


def nowcast_today_range(inputs: DataFrame, p: NowcastParams = NowcastParams()) -> DataFrame:
    """Sigma and bands of every row of nowcast_inputs() (or rows of its columns), with is_stale."""
    own = F.when(F.col("session").isin("PRE", "RTH", "AFT"), F.col("session")).otherwise(infer_session(F.col("asof_ts"), F.col("day")))
    out = inputs.withColumn("session", own).withColumn("bars_remaining", bars_remaining(F.col("asof_ts"), session_end(F.col("session"), F.col("day")), p.bar_minutes))
    out = remaining_var_frac(out, p)
    out = out.withColumns({"sigma_intraday": sigma_intraday(), "sigma_atr": sigma_atr(), "blend_weight": blend_weight(p), "is_stale": F.to_date("asof_ts") != F.col("day")})
    return with_bands(blend_sigma(out, p), p)


def position(last: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, ratio(last - low, high - low))
