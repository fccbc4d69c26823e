"""Support and resistance levels of every ticker and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlight.functions.columns import zone_half_width
from barlight.operators.session import last_price


def by_day() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("day")

#: Columns of a level before zones and ranks.
RAW = ("ticker", "day", "ord", "id", "kind", "source", "session", "price", "strength")


def true_range() -> Column:
    back = F.lag("close").over(by_day())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - back), F.abs(F.col("low") - back))


def atr(daily: DataFrame, n: int = 14) -> DataFrame:
    """daily with true_range and atr, the mean of the last n, null before there are n."""
    w = by_day().rowsBetween(-(n - 1), 0)
    out = daily.withColumn("true_range", true_range())
    return out.withColumn("atr", F.when(F.count("true_range").over(w) == n, F.avg("true_range").over(w)))


def _asof(daily: DataFrame, days: DataFrame, columns: Sequence[str], strict: bool) -> DataFrame:
    """days with the columns of each ticker's newest row before (or up to) the day: one window over both inputs."""
    own = daily.select("ticker", "day", F.struct("day", *columns).alias("_row"), F.lit(1 if strict else 0).alias("_side"))
    ask = days.select("ticker", "day", F.lit(None).alias("_row"), F.lit(0 if strict else 1).alias("_side"))
    w = Window.partitionBy("ticker").orderBy("day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(ask).withColumn("_last", F.last("_row", ignorenulls=True).over(w))
    return both.where(F.col("_side") == (0 if strict else 1)).select("ticker", "day", F.col("_last.day").alias("asof_day"), *[F.col(f"_last.{c}").alias(c) for c in columns])


def prior_day(daily: DataFrame, days: DataFrame) -> DataFrame:
    """high, low and close of the last bar before each day."""
    return _asof(daily, days, ("high", "low", "close"), True).where(F.col("asof_day").isNotNull())


def weeks(daily: DataFrame) -> DataFrame:
    """Bars of weeks that end on Friday: high, low and last close; day is the Friday."""
    friday = F.next_day(F.date_sub("day", 1), "FRI")
    return daily.groupBy("ticker", friday.alias("week")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "day").alias("close")).withColumnRenamed("week", "day")


def prior_week(daily: DataFrame, days: DataFrame) -> DataFrame:
    """The last week whose Friday is before each day."""
    return _asof(weeks(daily), days, ("high", "low", "close"), True).where(F.col("asof_day").isNotNull())


def swing_pivots(daily: DataFrame, days: DataFrame, lookback: int = 120, k: int = 2) -> DataFrame:
    """Pivots that each day sees: ticker, day, side (high or low), price, pivot_day.

    A high is a pivot if it is strictly above those of k bars on either side; a day sees those among its last
    `lookback` bars, less k at either edge. The match of days with pivots is bounded by the lookback.
    """
    before, after = by_day().rowsBetween(-k, -1), by_day().rowsBetween(1, k)
    full = (F.count("high").over(before) == k) & (F.count("high").over(after) == k)
    n = daily.withColumn("idx", F.row_number().over(by_day())).withColumn("full", full).withColumn(
        "is_high", F.col("full") & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))).withColumn(
        "is_low", F.col("full") & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)))
    sides = F.array(F.when(F.col("is_high"), F.struct(F.lit("high").alias("side"), F.col("high").alias("price"))),
                    F.when(F.col("is_low"), F.struct(F.lit("low").alias("side"), F.col("low").alias("price"))))
    found = n.select("ticker", F.col("idx").alias("p"), F.col("day").alias("pivot_day"), F.explode(F.array_compact(sides)).alias("s"))
    asked = days.select("ticker", "day").join(n.select("ticker", "day", "idx"), ["ticker", "day"])
    # pivots and days meet by blocks of `lookback` bars, so a ticker's pairs are those within reach
    reach = asked.withColumn("block", F.explode(F.array(F.floor(F.col("idx") / lookback), F.floor(F.col("idx") / lookback) - 1)))
    found = found.withColumn("block", F.floor(F.col("p") / lookback))
    near = reach.join(found, ["ticker", "block"]).where((F.col("p") > F.col("idx") - lookback + k) & (F.col("p") <= F.col("idx") - k))
    return near.select("ticker", "day", "s.side", "s.price", "pivot_day")


def pivot_filter(pivots: DataFrame, context: DataFrame, atrs: float = 6.0) -> DataFrame:
    """Pivots within so many ATRs of the last price; all where either is missing. context: ticker, day, last, atr."""
    far = F.abs(F.col("price") - F.col("last")) > atrs * F.col("atr")
    return pivots.join(context.select("ticker", "day", "last", "atr"), ["ticker", "day"], "left").where(~F.coalesce(far, F.lit(False))).drop("last", "atr")


def pivot_topn(pivots: DataFrame, n: int = 12) -> DataFrame:
    """The n highest distinct high prices and n lowest low ones of each day, numbered by rising price."""
    each = pivots.select("ticker", "day", "side", "price").distinct()
    outer = Window.partitionBy("ticker", "day", "side").orderBy(F.when(F.col("side") == "high", -F.col("price")).otherwise(F.col("price")))
    inner = Window.partitionBy("ticker", "day", "side").orderBy("price")
    kept = each.withColumn("_n", F.row_number().over(outer)).where(F.col("_n") <= n).drop("_n")
    kept = kept.withColumn("no", F.row_number().over(inner))
    return kept.withColumn("id", F.concat(F.lit("sp_"), F.substring("side", 1, 1), F.lit("_"), F.col("no").cast("string")))


def _rows(df: DataFrame, entries: Sequence[tuple]) -> DataFrame:
    """Unpivots entries (ord, id, kind, source, session, price column, strength); those without a price go."""
    made = [F.struct(F.lit(o).alias("ord"), F.lit(i).alias("id"), F.lit(k).alias("kind"), F.lit(s).alias("source"), F.lit(x).cast("string").alias("session"),
                     F.col(p).alias("price"), F.lit(w).alias("strength")) for o, i, k, s, x, p, w in entries]
    return df.select("ticker", "day", F.explode(F.array(*made)).alias("l")).select("ticker", "day", "l.*").where("price IS NOT NULL").select(*RAW)


def day_levels(prior: DataFrame) -> DataFrame:
    return _rows(prior, [(1, "pd_h", "resistance", "prior_day", None, "high", 4), (2, "pd_l", "support", "prior_day", None, "low", 4), (3, "pd_c", "pivot", "prior_day", None, "close", 3)])


def week_levels(prior: DataFrame) -> DataFrame:
    return _rows(prior, [(4, "pw_h", "resistance", "prior_week", None, "high", 5), (5, "pw_l", "support", "prior_week", None, "low", 5), (6, "pw_c", "pivot", "prior_week", None, "close", 3)])


def pivot_levels(top: DataFrame) -> DataFrame:
    high = F.col("side") == "high"
    return top.select("ticker", "day", (F.when(high, 100).otherwise(200) + F.col("no")).alias("ord"), "id", F.when(high, "resistance").otherwise("support").alias("kind"),
                      F.lit("swing_pivot").alias("source"), F.lit(None).cast("string").alias("session"), "price", F.lit(2).alias("strength"))


def state_levels(state: DataFrame, opening: DataFrame, premarket: bool = True) -> DataFrame:
    """VWAP anchor, opening range, extremes of each session with bars, and the premarket's as context."""
    joined = state.join(opening.select("ticker", "day", F.col("high").alias("or_high"), F.col("low").alias("or_low")), ["ticker", "day"], "left")
    entries = [(300, "rth_vwap", "anchor", "vwap", "RTH", "rth_vwap", 4), (301, "or_h", "resistance", "opening_range", "RTH", "or_high", 4), (302, "or_l", "support", "opening_range", "RTH", "or_low", 4)]
    for i, s in enumerate(("pre", "rth", "aft")):
        entries += [(310 + 2 * i, f"{s}_h", "resistance", "session_extreme", s.upper(), f"{s}_high", 3), (311 + 2 * i, f"{s}_l", "support", "session_extreme", s.upper(), f"{s}_low", 3)]
    if premarket:
        entries += [(320, "pm_h", "resistance", "premarket_context", "PRE", "pre_high", 1), (321, "pm_l", "support", "premarket_context", "PRE", "pre_low", 1)]
    return _rows(joined, entries)


def levels_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def levels_dedupe(levels: DataFrame) -> DataFrame:
    """One level a source, price to the cent and session: the strongest, at the first one's place."""
    key = ["ticker", "day", "source", F.round("price", 2), F.coalesce("session", F.lit(""))]
    best = Window.partitionBy(*key).orderBy(F.desc("strength"), "ord")
    out = levels.withColumn("_n", F.row_number().over(best)).withColumn("pos", F.min("ord").over(Window.partitionBy(*key)))
    return out.where("_n = 1").drop("_n")


def levels_topk(levels: DataFrame, context: DataFrame, k: int = 40) -> DataFrame:
    """The k first by strength, distance to the last price (0 if unknown) and place."""
    out = levels.join(context.select("ticker", "day", "last", "atr"), ["ticker", "day"], "left")
    dist = F.coalesce(F.abs(F.col("price") - F.col("last")), F.lit(0.0))
    w = Window.partitionBy("ticker", "day").orderBy(F.desc("strength"), dist, "pos")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_zones(levels: DataFrame) -> DataFrame:
    half = zone_half_width(F.col("price"), F.col("atr"))
    return levels.withColumn("zone_low", F.col("price") - half).withColumn("zone_high", F.col("price") + half)


def level_context(daily: DataFrame, state: DataFrame) -> DataFrame:
    """ticker, day, last and atr: the state's price and the ATR as of the day."""
    days = state.select("ticker", "day")
    at = _asof(atr(daily), days, ("atr",), False).select("ticker", "day", "atr")
    return state.select("ticker", "day", last_price(F.col("rth_close"), F.col("pre_close")).alias("last")).join(at, ["ticker", "day"], "left")


def compute_levels(daily: DataFrame, state: DataFrame, opening: DataFrame, k: int = 40, context: DataFrame | None = None) -> DataFrame:
    """Ranked levels with zones of every ticker and day that has state; context is level_context()'s, if it is there."""
    days = state.select("ticker", "day")
    context = level_context(daily, state) if context is None else context
    top = pivot_topn(pivot_filter(swing_pivots(daily, days), context))
    every = levels_union(day_levels(prior_day(daily, days)), week_levels(prior_week(daily, days)), pivot_levels(top), state_levels(state, opening))
    return with_zones(levels_topk(levels_dedupe(every), context, k))
