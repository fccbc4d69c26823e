"""Plan for the next session: range, key levels, risk notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.operators import localize

# Range multipliers by regime; anything else counts as a transition.
MULTIPLIERS = {"trend_up": 1.05, "trend_down": 1.05, "range": 0.90, "high_vol": 1.30, "transition": 1.15}
#: Sigmas of the 45, 68 and 95 % bands.
BAND_Z = (("45", 0.55), ("68", 1.00), ("95", 2.00))


def multiplier(regime: Column) -> Column:
    out = F.lit(MULTIPLIERS["transition"])
    for name, m in MULTIPLIERS.items():
        out = F.when(regime == name, m).otherwise(out)
    return out


def tomorrow_range(features: DataFrame, regimes: DataFrame) -> DataFrame:
    """Bands around each row's close; status tells where close or ATR is missing. regimes: ticker, day, regime."""
    out = features.select("ticker", "day", "close", "atr", "rv", "gap_atr").join(regimes.select("ticker", "day", "regime"), ["ticker", "day"], "left")
    ok = F.col("close").isNotNull() & (F.col("atr") > 1e-6)
    out = out.withColumns({"regime": F.coalesce("regime", F.lit("transition")), "status": F.when(F.coalesce(ok, F.lit(False)), "ok").when(F.col("close").isNull(), "no close").otherwise("no atr")})
    out = out.withColumn("sigma_pts", F.when(F.col("status") == "ok", F.col("atr") * multiplier(F.col("regime"))))
    return out.withColumns({f"{side}_{n}": F.col("close") + sign * z * F.col("sigma_pts") for n, z in BAND_Z for side, sign in (("low", -1), ("high", 1))})


def next_session(days: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """days with next_day: the first calendar day after, else the next weekday. calendar: a column day of sessions."""
    d = F.dayofweek("day")
    weekday = F.date_add("day", F.when(d == 6, 3).when(d == 7, 2).otherwise(1))
    if calendar is None:
        return days.withColumn("next_day", weekday)
    # sessions of the two weeks that follow a day; distinct days and sessions are few
    asked = days.select("day").distinct().withColumn("c", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 14))))
    following = asked.join(calendar.select(F.col("day").alias("c")).distinct(), "c").groupBy("day").agg(F.min("c").alias("_next"))
    return days.join(following, "day", "left").withColumn("next_day", F.coalesce("_next", weekday)).drop("_next")


def key_levels(levels: DataFrame, px: DataFrame, n: int = 6) -> DataFrame:
    """The n levels on each side of the price nearest by the middle of their zone. px: ticker, day, px."""
    mid = (F.col("zone_low") + F.col("zone_high")) / 2
    out = levels.drop("last", "atr").join(px.select("ticker", "day", "px"), ["ticker", "day"]).withColumns({"side": F.when(mid <= F.col("px"), "support").otherwise("resistance"), "dist_pts": F.abs(mid - F.col("px"))})
    w = Window.partitionBy("ticker", "day", "side").orderBy("dist_pts", "rank")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("ticker", "day", "side", "place", "id", "kind", "source", "zone_low", "zone_high", "strength", "dist_pts")


def note_items() -> Column:
    """Risk notes of a row as key|value: its regime, gap, realised volatility and ATR."""
    c = F.col
    note = lambda key, *value: F.concat_ws("|", F.lit(key), *value)
    return F.array_compact(F.array(
        F.when(c("regime").isin("high_vol", "transition"), note("N_REGIME", c("regime"))),
        F.when(F.abs(c("gap_atr")) >= 0.8, note("N_GAP", F.format_string("%.2f", c("gap_atr")))),
        F.when(c("rv") >= 0.02, note("N_RV", F.format_string("%.3f", c("rv")))),
        F.when(c("atr") <= 0, note("N_ATR"))))


def risk_notes() -> Column:
    """note_items() in English."""
    return F.transform(note_items(), lambda item: localize.note_text(item, "en"))


def eod_plan(features: DataFrame, regimes: DataFrame, levels: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """One row a ticker and day: range, next session, notes, and up to six key levels on each side in order."""
    out = next_session(tomorrow_range(features, regimes), calendar).withColumn("risk_notes", risk_notes())
    keys = key_levels(levels, out.select("ticker", "day", F.col("close").alias("px")))
    level = F.struct("place", "id", "kind", "source", "zone_low", "zone_high", "strength", "dist_pts")
    listed = keys.groupBy("ticker", "day").agg(F.array_sort(F.collect_list(F.when(F.col("side") == "support", level))).alias("supports"),
                                               F.array_sort(F.collect_list(F.when(F.col("side") == "resistance", level))).alias("resistances"))
    return out.join(listed, ["ticker", "day"], "left")
