"""Stall and breakout likelihoods, guidance and its reasons, from levels and the nowcast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.columns import clamp01, ratio, sigmoid
from barlight.operators.nowcast import position


@dataclass(frozen=True)
class InsightParams:
    er_lo: float = 0.45
    er_hi: float = 0.60
    overlap_lo: float = 0.45
    overlap_hi: float = 0.62
    sigma_lo: float = 0.18
    sigma_hi: float = 0.45
    near_atr: float = 0.25
    zone_bonus: float = 0.20
    late_bars: int = 6
    directional: float = 0.62
    stall: float = 0.70
    bands: tuple = (0.45, 0.68, 0.95)


SUPPORTS, RESISTANCES = ("support", "pivot", "anchor"), ("resistance", "pivot", "anchor")


def zone_distance(last: Column, low: Column, high: Column) -> Column:
    """0 within a zone, else the distance to its nearer edge."""
    return F.greatest(low - last, last - high, F.lit(0.0))


def nearest_levels(px: DataFrame, levels: DataFrame) -> DataFrame:
    """px (ticker, day, last_price) with sup_ and res_ columns of the nearest level of each side; ties go to the rank.

    A day has at most 40 levels, so the equi-join on ticker and day is bounded; the pick is one aggregate.
    """
    l = levels.select("ticker", "day", "rank", "id", "kind", "source", "zone_low", "zone_high", "strength")  # noqa: E741
    both = px.select("ticker", "day", "last_price").join(l, ["ticker", "day"], "left")
    dist = zone_distance(F.col("last_price"), F.col("zone_low"), F.col("zone_high"))
    sup = F.col("kind").isin(*SUPPORTS) & (F.col("zone_low") <= F.col("last_price"))
    res = F.col("kind").isin(*RESISTANCES) & (F.col("zone_high") >= F.col("last_price"))
    row = F.struct(dist.alias("dist"), "rank", "id", "kind", "source", "zone_low", "zone_high", "strength")
    picked = both.groupBy("ticker", "day").agg(F.min(F.when(sup, row)).alias("sup"), F.min(F.when(res, row)).alias("res"))
    names = ("dist", "id", "kind", "source", "zone_low", "zone_high", "strength")
    return picked.select("ticker", "day", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("sup", "res") for c in names])


def zone_strength(strength: Column) -> Column:
    return F.coalesce(clamp01((strength - 1) / 4.0), F.lit(0.0))


def level_distance_atr(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{s}_dist_atr": ratio(F.col(f"{s}_dist"), F.col("atr")) for s in ("sup", "res")} | {
        f"{s}_name": F.coalesce(F.nullif(F.col(f"{s}_id"), F.lit("")), F.col(f"{s}_source")) for s in ("sup", "res")})


def tape_scores(df: DataFrame, p: InsightParams = InsightParams()) -> DataFrame:
    """trend, chop and vol from 0 to 1; a missing input gives 0."""
    out = df.withColumn("sigma_rem_atr", ratio(F.col("sigma_pts"), F.col("atr")))
    scaled = lambda c, lo, hi: F.coalesce(clamp01((F.col(c) - lo) / (hi - lo)), F.lit(0.0))
    return out.withColumns({"trend": F.when(F.col("er").isNull(), 0.0).otherwise(scaled("er", p.er_lo, p.er_hi)),
                            "chop": F.when(F.col("overlap").isNull(), 0.0).otherwise(scaled("overlap", p.overlap_lo, p.overlap_hi)),
                            "vol": F.when(F.col("sigma_rem_atr").isNull(), 0.0).otherwise(scaled("sigma_rem_atr", p.sigma_lo, p.sigma_hi))})


def near_scores(df: DataFrame, p: InsightParams = InsightParams()) -> DataFrame:
    near = lambda s: F.when(F.col(f"{s}_dist_atr").isNull(), 0.0).otherwise(clamp01(
        F.greatest(F.lit(0.0), 1 - F.col(f"{s}_dist_atr") / p.near_atr) * (0.5 + 0.5 * zone_strength(F.col(f"{s}_strength")))))
    out = df.withColumns({"near_sup": near("sup"), "near_res": near("res")})
    inside = F.coalesce(F.col("sup_dist_atr") <= 0, F.lit(False)) | F.coalesce(F.col("res_dist_atr") <= 0, F.lit(False))
    return out.withColumns({"near_any": F.greatest("near_sup", "near_res"), "inside_bonus": F.when(inside, p.zone_bonus).otherwise(0.0)})


def likelihoods(df: DataFrame) -> DataFrame:
    """stall, breakout_up and breakout_down."""
    c = F.col
    out = df.withColumn("pos_68", position(c("last_price"), c("rem_low_68"), c("rem_high_68")))
    out = out.withColumn("stall", sigmoid(1.10 * c("chop") + 0.70 * c("near_any") + 0.50 * (1 - c("vol")) + c("inside_bonus") - 1.0))
    tilt = F.coalesce(0.35 * (c("pos_68") - 0.5), F.lit(0.0))
    raw = lambda near, sign: 1.10 * c("trend") + 0.80 * c("vol") + 0.65 * c(near) - 0.75 * c("chop") + sign * tilt
    damp = 1 - 0.55 * c("stall")
    return out.withColumns({"breakout_up": sigmoid(raw("near_res", 1)) * damp, "breakout_down": sigmoid(raw("near_sup", -1)) * damp})


def guidance(df: DataFrame, p: InsightParams = InsightParams()) -> DataFrame:
    """Trade bias and flags, rule by rule in order; a null passes its rule over, but a null er counts as weak."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    out = df.withColumns({"late": yes((c("bars_remaining") > 0) & (c("bars_remaining") <= p.late_bars)), "low_move": yes(c("sigma_rem_atr") < p.sigma_lo)})
    out = out.withColumn("_avoid", c("late") | c("low_move"))
    out = out.withColumn("mean_reversion_preferred", ~c("_avoid") & yes(c("overlap") >= p.overlap_hi) & (c("er").isNull() | (c("er") < p.er_lo)))
    free = ~c("_avoid") & ~c("mean_reversion_preferred")
    out = out.withColumns({"up": free & yes((c("breakout_up") >= p.directional) & (c("breakout_up") > c("breakout_down"))),
                           "down": free & yes((c("breakout_down") >= p.directional) & (c("breakout_down") > c("breakout_up")))})
    out = out.withColumn("unclear", ~c("_avoid") & yes(c("sigma_rem_atr") >= p.sigma_hi) & ~(c("up") | c("down")))
    out = out.withColumn("stalled", yes(c("stall") >= p.stall))
    return out.withColumns({
        "trade_bias": F.when(c("mean_reversion_preferred"), "range/mean_reversion").when(c("up"), "bullish_breakout").when(c("down"), "bearish_breakout").otherwise("neutral"),
        "directional_premium_allowed": (c("up") | c("down")) & ~c("stalled"), "prefer_spreads": c("mean_reversion_preferred") | c("unclear"),
        "avoid_trading": c("_avoid") | (c("stalled") & ~c("mean_reversion_preferred"))}).drop("_avoid")


def rationale(df: DataFrame) -> DataFrame:
    """rationale: the rules of guidance() that fired, in order, as key|value|value."""
    c = F.col
    num = lambda x, d: F.when(c(x).isNull(), "NA").otherwise(F.format_string(f"%.{d}f", c(x)))
    key = lambda k, *v: F.concat_ws("|", F.lit(k), *v)
    items = [F.when(c("late"), key("R_LATE_SESSION", c("bars_remaining").cast("string"))), F.when(c("low_move"), key("R_LOW_REMAINING_MOVE", num("sigma_rem_atr", 3))),
             F.when(c("mean_reversion_preferred"), key("R_CHOPPY_TAPE")), F.when(c("mean_reversion_preferred"), key("R_OVERLAP_ER", num("overlap", 3), num("er", 3))),
             F.when(c("up"), key("R_BREAKOUT_UP_ELEVATED", num("breakout_up", 2))), F.when(c("down"), key("R_BREAKOUT_DOWN_ELEVATED", num("breakout_down", 2))),
             F.when(c("unclear"), key("R_HIGH_VOL_UNCLEAR_DIR")), F.when(c("stalled"), key("R_STALL_HIGH_NEAR_LEVELS", num("stall", 2)))]
    return df.withColumn("rationale", F.array_compact(F.array(*items)))


# Coefficients of the published rational approximation of the inverse normal distribution.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def norm_ppf(p: Column) -> Column:
    """Inverse of the normal distribution, null outside (0, 1)."""

    def poly(coefficients: tuple, x: Column) -> Column:
        out = F.lit(coefficients[0])
        for a in coefficients[1:]:
            out = out * x + a
        return out

    tail = lambda q: poly(PPF_C, q) / poly((*PPF_D, 1.0), q)
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when((p > 0) & (p < 0.02425), tail(low)).when((p >= 0.02425) & (p <= 1 - 0.02425), poly(PPF_A, r) * q / poly((*PPF_B, 1.0), r)).when((p > 1 - 0.02425) & (p < 1), -tail(high))


def central_bands(df: DataFrame, probs: tuple = InsightParams().bands) -> DataFrame:
    """A row for each row of df and central probability: low and high around the last price; none without a sigma."""
    dim = df.sparkSession.createDataFrame([(float(x),) for x in probs], "prob double").withColumn("z", norm_ppf(0.5 + F.col("prob") / 2))
    z = F.col("z") * F.col("sigma_pts")
    return df.where(F.col("sigma_pts") > 0).select("ticker", "day", "last_price", "sigma_pts").crossJoin(F.broadcast(dim)).select(
        "ticker", "day", "prob", "z", (F.col("last_price") - z).alias("low"), (F.col("last_price") + z).alias("high"))


def range_context(df: DataFrame) -> DataFrame:
    """ctx_ bands of 45, 68 and 95 % and the last price's place in each; 68 and 95 are the nowcast's where it has them."""
    new = {}
    for name, prob, own in (("45", 0.45, False), ("68", 0.68, True), ("95", 0.95, True)):
        z = norm_ppf(F.lit(0.5 + prob / 2)) * F.when(F.col("sigma_pts") > 0, F.col("sigma_pts"))
        low, high = F.col("last_price") - z, F.col("last_price") + z
        new |= {f"ctx_low_{name}": F.coalesce(F.col(f"rem_low_{name}"), low) if own else low, f"ctx_high_{name}": F.coalesce(F.col(f"rem_high_{name}"), high) if own else high}
        # places come from the recomputed band, but for 68 % from the nowcast's
        new[f"pos_in_{name}"] = F.coalesce(position(F.col("last_price"), F.col("rem_low_68"), F.col("rem_high_68")), position(F.col("last_price"), low, high)) if name == "68" else position(F.col("last_price"), low, high)
    return df.withColumns(new)


def intraday_insights(today: DataFrame, levels: DataFrame, p: InsightParams = InsightParams()) -> DataFrame:
    """today_range rows with an ATR above zero, joined to their nearest levels, scored and explained."""
    near = nearest_levels(today, levels)
    out = level_distance_atr(today.where(F.col("atr") > 0).join(near, ["ticker", "day"], "left"))
    return range_context(rationale(guidance(likelihoods(near_scores(tape_scores(out, p), p)), p)))
