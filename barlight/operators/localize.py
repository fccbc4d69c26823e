"""Labels and notes in English, Chinese or both, by joins with small label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Display labels of fields, (field, English, Chinese).
FIELDS = (
    ("ticker", "Ticker", "股票代码"),
    ("day", "Plan Day", "计划生成日（EOD）"),
    ("asof_day", "As-of Trading Day", "数据对应交易日"),
    ("predicted_day", "Predicted Session Date", "预测交易日"),
    ("market_tz", "Market TZ", "市场时区"),
    ("asof_ts", "As-of Timestamp", "数据时间戳（as-of）"),
    ("today_close", "Close (As-of Day)", "基准收盘价（as-of）"),
    ("regime_context", "Regime Context", "市场状态（Regime）"),
    ("asof_label_day", "Label As-of Day", "状态标签对应交易日"),
    ("asof_regime", "Regime", "市场状态"),
    ("tomorrow_range", "Tomorrow Range", "次日价格区间（概率带）"),
    ("band_45", "Band (45%)", "概率带（45%）"),
    ("band_68", "Band (68%)", "概率带（68%）"),
    ("band_95", "Band (95%)", "概率带（95%）"),
    ("low", "Low", "下界"),
    ("high", "High", "上界"),
    ("tomorrow_key_levels", "Key Levels (Next Session)", "次日关键价位区（支撑/阻力带）"),
    ("supports", "Support Zones", "支撑带（需求区）"),
    ("resistances", "Resistance Zones", "阻力带（供给区）"),
    ("id", "ID", "标识"),
    ("kind", "Type", "类型"),
    ("zone_low", "Zone Low", "区间下沿"),
    ("zone_high", "Zone High", "区间上沿"),
    ("strength", "Strength", "强度"),
    ("source", "Source", "来源"),
    ("dist_pts", "Distance (pts)", "距离（点）"),
    ("risk_notes", "Risk Notes", "风险提示"),
    ("sources", "Sources", "数据来源"),
    ("daily_latest", "Daily Latest", "日线特征（latest）"),
    ("regime_labels_latest", "Regime Labels Latest", "状态标签（latest）"),
    ("levels_latest", "Levels Latest", "关键价位（latest）"),
    ("session", "Session", "交易时段"),
    ("last_price", "Last Price", "最新价"),
    ("atr", "Daily ATR", "ATR(日线,14)"),
    ("rv", "5m RV", "5分钟实现波动(RV)"),
    ("er", "Efficiency Ratio (ER)", "效率比(ER)"),
    ("overlap", "Overlap", "K线重叠度(Overlap)"),
    ("sigma_pts", "Remaining Sigma (pts)", "剩余波动σ(点)"),
    ("sigma_rem_atr", "Remaining Sigma / ATR", "剩余σ/ATR"),
    ("bars_remaining", "Bars Remaining (5m)", "剩余5分钟K线(根)"),
    ("dist_vwap_atr", "Distance to VWAP (ATR)", "距VWAP(ATR)"),
    ("pos_rth_range", "Position in RTH Range", "RTH区间位置"),
)
# Translations of values, (kind of value, value, English, Chinese).
VALUES = (
    ("regime", "trend_up", "trend_up", "上行趋势"),
    ("regime", "trend_down", "trend_down", "下行趋势"),
    ("regime", "range", "range", "区间震荡"),
    ("regime", "high_vol", "high_vol", "高波动（方向不明）"),
    ("regime", "transition", "transition", "状态切换期"),
    ("regime", "unknown", "unknown", "未知"),
    ("kind", "pivot", "pivot", "枢轴位"),
    ("kind", "support", "support", "支撑"),
    ("kind", "resistance", "resistance", "阻力"),
    ("kind", "anchor", "anchor", "锚点"),
    ("source", "prior_day", "prior_day", "前一交易日"),
    ("source", "prior_week", "prior_week", "上一周"),
    ("source", "swing_pivot", "swing_pivot", "摆动枢轴"),
    ("source", "opening_range", "opening_range", "开盘区间（OR）"),
    ("source", "vwap", "vwap", "成交量加权均价（VWAP）"),
    ("source", "session_extreme", "session_extreme", "时段极值"),
    ("source", "premarket_context", "premarket_context", "盘前上下文"),
    ("trade_bias", "neutral", "Neutral", "中性"),
    ("trade_bias", "range/mean_reversion", "Range / Mean Reversion", "区间/均值回归"),
    ("trade_bias", "bullish_breakout", "Bullish Breakout", "向上突破"),
    ("trade_bias", "bearish_breakout", "Bearish Breakout", "向下突破"),
)
# Texts of rationale keys, {0} and {1} being their values.
TEMPLATES = (
    ("R_LATE_SESSION", "Late session: bars_remaining={0}", "临近收盘：剩余K线数={0}"),
    ("R_LOW_REMAINING_MOVE", "Low remaining movement: sigma_rem_atr={0}", "剩余波动偏低：sigma_rem_atr={0}"),
    ("R_CHOPPY_TAPE", "Choppy / overlapping tape; trend signal weak", "行情偏震荡、重叠度高；趋势信号偏弱"),
    ("R_OVERLAP_ER", "overlap={0} er={1}", "重叠度={0} ER={1}"),
    ("R_BREAKOUT_UP_ELEVATED", "Breakout-up likelihood elevated ({0})", "向上突破概率偏高({0})"),
    ("R_BREAKOUT_DOWN_ELEVATED", "Breakout-down likelihood elevated ({0})", "向下突破概率偏高({0})"),
    ("R_HIGH_VOL_UNCLEAR_DIR", "High remaining volatility with unclear direction; defined-risk structures preferred", "剩余波动率高且方向不明确；更适合使用风险限定的结构(例如价差/铁鹰等)"),
    ("R_STALL_HIGH_NEAR_LEVELS", "Stall likelihood high ({0}) near key levels", "在关键价位附近横盘/停滞概率较高({0})"),
)
# Texts of risk notes by key, {0} being the value.
RISK_NOTES = (
    ("N_REGIME", "Regime={0}: consider wider error bars and defined-risk structures.", "市场状态={0}：建议扩大误差带，优先采用限定风险结构（如价差、铁鹰等）。"),
    ("N_GAP", "Large gap vs ATR (gap_atr={0}): open may be discontinuous.", "跳空幅度相对ATR偏大（gap_atr={0}）：开盘可能出现价格不连续跳变。"),
    ("N_RV", "Elevated realized vol proxy (rv={0}).", "短期实现波动偏高（rv={0}）。"),
    ("N_ATR", "ATR invalid (should not happen).", "ATR异常（理论上不应发生）。"),
)


def field_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIELDS), "field string, en string, zh string")


def value_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VALUES), "what string, value string, en string, zh string")


def in_mode(en: Column, zh: Column, mode: str, by: str = "/") -> Column:
    """The text of a mode (en, zh or both); where one is missing or both are equal, the other alone."""
    if mode == "en":
        return F.coalesce(en, zh)
    if mode == "zh":
        return F.coalesce(zh, en)
    return F.when(en.isNull() | zh.isNull() | (en == zh), F.coalesce(en, zh)).otherwise(F.concat(en, F.lit(by), zh))


def unpivoted(wide: DataFrame, keys: tuple, columns: list[str]) -> DataFrame:
    """A row for each column of a payload: keys, field, value (as text)."""
    entries = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def localize_fields(rows: DataFrame, labels: DataFrame, mode: str = "both") -> DataFrame:
    """rows (field, ...) with label; unknown fields keep their name."""
    out = rows.join(F.broadcast(labels), "field", "left")
    return out.withColumn("label", F.coalesce(in_mode(F.col("en"), F.col("zh"), mode), F.col("field"))).drop("en", "zh")


def localize_values(rows: DataFrame, labels: DataFrame, mode: str = "both") -> DataFrame:
    """rows (what, value, ...) with text; values are matched trimmed and in lower case, unknown ones stay."""
    l = labels.select(F.col("what").alias("_w"), F.col("value").alias("_v"), "en", "zh")  # noqa: E741
    out = rows.join(F.broadcast(l), (F.col("what") == F.col("_w")) & (F.lower(F.trim("value")) == F.col("_v")), "left")
    return out.withColumn("text", F.coalesce(in_mode(F.col("en"), F.col("zh"), mode), F.col("value"))).drop("_w", "_v", "en", "zh")


def localize_rationale(rows: DataFrame, mode: str = "both") -> DataFrame:
    """rows (note as key|value|value) with text; unknown keys stay."""
    spark = rows.sparkSession
    dim = spark.createDataFrame(list(TEMPLATES), "_key string, en string, zh string")
    parts = F.split("note", r"\|")
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("{0}"), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit("{1}"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")))
    out = rows.join(F.broadcast(dim), F.get(parts, F.lit(0)) == F.col("_key"), "left")
    return out.withColumn("text", F.coalesce(in_mode(fill("en"), fill("zh"), mode, " / "), F.col("note"))).drop("_key", "en", "zh")


def note_text(item: Column, language: str) -> Column:
    """Text of a risk note key|value in one language (en or zh); null for an unknown key."""
    parts = F.split(item, r"\|")
    key, value = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    if language == "zh":
        names = {v: zh for what, v, _, zh in VALUES if what == "regime"}
        value = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value)
    out = F.lit(None).cast("string")
    for name, en, zh in RISK_NOTES:
        out = F.when(key == name, F.replace(F.lit(en if language == "en" else zh), F.lit("{0}"), value)).otherwise(out)
    return out


def localize_notes(rows: DataFrame, mode: str = "both") -> DataFrame:
    """rows (item as key|value) with text; unknown items stay as they are."""
    item = F.col("item")
    return rows.withColumn("text", F.coalesce(in_mode(note_text(item, "en"), note_text(item, "zh"), mode, " / "), item))
