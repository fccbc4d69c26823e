"""Rule-based regimes of daily features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.columns import ratio


@dataclass(frozen=True)
class RegimeParams:
    high_vol_range_atr: float = 1.35
    trend_er: float = 0.55
    trend_slope: float = 3e-4
    range_er: float = 0.40


def slope_norm() -> Column:
    return ratio(F.col("slope_close"), F.col("close"))


def label_regimes(features: DataFrame, params: RegimeParams = RegimeParams()) -> DataFrame:
    """day, close, er, slope_n, range_atr, regime, regime_prev and changed of every row; a null skips its rule."""
    er, slope, p = F.col("er"), F.col("slope_n"), params
    regime = (F.when(F.col("range_atr") >= p.high_vol_range_atr, "high_vol").when((er >= p.trend_er) & (slope >= p.trend_slope), "trend_up")
              .when((er >= p.trend_er) & (slope <= -p.trend_slope), "trend_down").when(er <= p.range_er, "range").otherwise("transition"))
    out = features.withColumn("slope_n", slope_norm()).withColumn("regime", regime)
    out = out.withColumn("regime_prev", F.lag("regime").over(Window.partitionBy("ticker").orderBy("day")))
    return out.select("ticker", "day", "close", "er", "slope_n", "range_atr", "regime", "regime_prev", F.coalesce(F.col("regime") != F.col("regime_prev"), F.lit(True)).alias("changed"))


def regime_asof(labels: DataFrame, day: Column) -> DataFrame:
    """Rows up to the day, last label day and its regime of each ticker."""
    return labels.where(F.col("day") <= day).groupBy("ticker").agg(
        F.count("*").alias("rows"), F.max("day").alias("asof_label_day"), F.max_by("regime", "day").alias("asof_regime"))


def regime_latest(labels: DataFrame, day: Column) -> DataFrame:
    """The row of exactly the day, else the last one, of each ticker."""
    w = Window.partitionBy("ticker").orderBy(F.desc(F.col("day") == day), F.desc("day"))
    return labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ticker", "day", "regime", "changed", "close", "er", "slope_n", "range_atr")
