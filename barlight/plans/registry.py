"""All queries of the library over the driver's tables, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.functions import columns as C
from barlight.operators import clean, eod, features, insights, levels, localize, ml, nowcast, regimes, session
from barlight.plans import nightly, pipelines
from barlight.plans.oracle import query, select
from barlight.sources import bars as src
from barlight.sources.models import ModelTable
from barlight.sources.shared import finished, fresh_path, paths, stored, swept_on_failure
from barlight.streaming import session as streams
from barlight.streaming import sinks

DAY, AS_OF = "2024-01-20", "1998-06-30"


def date(text: str):
    return F.lit(text).cast("date")


def publish(df: DataFrame) -> DataFrame:
    """Doubles to six places, by arithmetic that is the same in other engines; whole numbers as longs."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((F.floor(c * 1e6 + 0.501) / 1e6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c.cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else c)
    return df.select(*out)


class Tables:
    """Inputs of the queries and the steps of the chain, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def ticks(self) -> DataFrame:
        return src.ticks_from_events(self.raw("events"))

    @property
    def bars(self) -> DataFrame:
        return clean.build_bars(self.ticks)

    @property
    def daily(self) -> DataFrame:
        return clean.build_bars(self.ticks, "1 day")

    @property
    def long_daily(self) -> DataFrame:
        return clean.build_bars(src.ticks_from_lineitem(self.raw("lineitem")), "1 day", F.col("seq"))

    @cached_property
    def kept_bars(self) -> DataFrame:
        """Bars of the chain: ticks are read once, every later step reads the bars."""
        return stored(self.bars, "bars")

    @cached_property
    def kept_daily(self) -> DataFrame:
        return stored(clean.daily_of_bars(self.kept_bars), "daily")

    @property
    def agg(self) -> DataFrame:
        return session.session_agg(self.kept_bars)

    @cached_property
    def parts(self) -> dict[str, DataFrame]:
        return pipelines.intraday_parts(self.kept_bars, self.kept_daily, self.state)

    @cached_property
    def state(self) -> DataFrame:
        return stored(session.session_state(self.agg), "state")

    @property
    def today(self) -> DataFrame:
        return nowcast.nowcast_today_range(self.parts["inputs"])

    @property
    def insights(self) -> DataFrame:
        return insights.intraday_insights(stored(self.today, "today"), self.parts["levels"])

    @property
    def universe(self) -> DataFrame:
        return self.raw("events").select(F.col("event_type").alias("ticker")).distinct().withColumns({"provider_symbol": F.concat(F.lit(" $"), F.upper("ticker")), "kind": F.lit("stock")})

    @cached_property
    def features(self) -> DataFrame:
        return stored(features.daily_features(self.kept_daily, min_rows=1), "features")

    @property
    def labels(self) -> DataFrame:
        return regimes.label_regimes(self.features)

    @cached_property
    def long_features(self) -> DataFrame:
        return stored(features.daily_features(self.long_daily), "features")

    @cached_property
    def training(self) -> DataFrame:
        own = self.long_features
        return stored(ml.time_split(ml.training_set(own, regimes.label_regimes(own))), "training")

    @property
    def predictions(self) -> DataFrame:
        """A fixed rule in place of a model, so that metrics can be compared."""
        said = F.when(F.col("er") >= 0.5, "trend_up").when(F.col("range_atr") >= 1.2, "high_vol").otherwise("range")
        return self.training.where("split = 'holdout'").select("ticker", "day", "regime", said.alias("prediction"))

    def scratch(self, name: str) -> str:
        return fresh_path(self.spark, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Registers a query under a key; the function takes the tables. A query that stores tables on its way has its result
    stored and those deleted; the others stay lazy."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with swept_on_failure(spark) as since:
                out = publish(f(Tables(spark, sf_dir)))
                return finished(out, key, since) if len(paths()) > since else out

        QUERIES[key] = run
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def simple(key: str, f: Callable[[Tables], DataFrame], spec: str, step: str, where: str = "") -> None:
    """A query whose columns are those of the oracle's step."""
    names = [c.rstrip("*#").partition("=")[0] for c in spec.split()]
    register(key, select(spec, step, where))(lambda t: f(t).select(*names))


BAR = "open* high* low* close* volume*"

# sources and ingest
simple("bars_5m", lambda t: t.bars, f"ticker day ts {BAR} session", "b")
simple("bars_daily", lambda t: t.daily, f"ticker day {BAR}", "d")
simple("bars_daily_long", lambda t: t.long_daily, f"ticker day {BAR}", "ld")
simple("universe_join", lambda t: src.with_universe(t.raw("events").select("event_id", F.concat(F.lit("$"), F.upper("event_type")).alias("symbol")), t.universe).select("event_id", "ticker", "kind"),
       "event_id ticker kind", "(SELECT event_id, event_type AS ticker, 'stock' AS kind FROM events)")


@register("scan_bars", query((
    "SELECT ticker, day, floor((open) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS open, "
    "floor((high) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS high, "
    "floor((low) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS low, "
    "floor((close) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS close, "
    "floor((volume) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS volume FROM d")))
def scan_bars(t: Tables) -> DataFrame:
    """A round trip through the sink, and no rows from a path that isn't there."""
    path = t.scratch("bars")
    src.write_bars(t.daily, path)
    return src.scan_bars(t.spark, path, src.BARS_DAILY).unionByName(src.scan_bars(t.spark, path + "-none", src.BARS_DAILY))


@register("sink_bars", query((
    "SELECT ticker, day, ts, floor((close) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS close FROM b "
    "WHERE day <> DATE '2024-01-20' UNION ALL SELECT ticker, day, ts, "
    "floor((close + 1) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE FROM b WHERE day = DATE '2024-01-20'")))
def sink_bars(t: Tables) -> DataFrame:
    """A second write replaces only the day that it has."""
    path = t.scratch("bars5m")
    src.write_bars(t.bars, path)
    src.write_bars(t.bars.where(F.col("day") == date(DAY)).withColumn("close", F.col("close") + 1), path)
    return src.scan_bars(t.spark, path, src.BARS_5M).select("ticker", "day", "ts", "close")


@register("append_log", query((
    "SELECT ticker, CAST(day AS VARCHAR) AS day, floor((last) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE "
    "AS last, CAST(2 AS BIGINT) AS times FROM ctx")))
def append_log(t: Tables) -> DataFrame:
    """Two appends of the same rows, read back as JSON lines."""
    path, rows = t.scratch("log"), t.parts["context"].select("ticker", "day", "last")
    src.append_log(rows, path)
    src.append_log(rows, path)
    found = src.scan_log(t.spark, path, T.StructType([T.StructField("ticker", T.StringType()), T.StructField("last", T.DoubleType()), T.StructField("day", T.DateType())]))
    return found.groupBy("ticker", F.col("day").cast("string").alias("day"), "last").agg(F.count("*").alias("times"))


@register("scan_log", query((
    "SELECT ticker, CAST(day AS VARCHAR) AS day, floor((close) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE "
    "AS close FROM d")))
def scan_log(t: Tables) -> DataFrame:
    path = t.scratch("log")
    src.append_log(t.daily.select("ticker", "day", "close"), path)
    return src.scan_log(t.spark, path).select("ticker", F.col("day").cast("string").alias("day"), "close")


def _provider(t: Tables, daily: bool) -> DataFrame:
    """Events as provider rows: text columns, some of them no numbers."""
    day = F.date_format("ts", "yyyy-MM-dd") if daily else F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    price = F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return t.raw("events").select("event_id", day.alias("Date" if daily else "Datetime"), *[price.alias(c) for c in ("Open", "High", "Low", "Close")], F.lit("1").alias("Volume"))


simple("normalize_daily", lambda t: src.normalize_bars(_provider(t, True), "daily", ("event_id",)), f"event_id day {BAR}",
       (
           "(SELECT event_id, CAST(ts AS DATE) AS day, value AS open, value AS high, value AS low, value AS close, "
           "1.0::DOUBLE AS volume FROM events WHERE event_id % 97 <> 0)"))
simple("normalize_intraday", lambda t: src.normalize_bars(_provider(t, False), "5m", ("event_id",)), f"event_id ts day {BAR}",
       (
           "(SELECT event_id, timezone('America/New_York', timezone('UTC', date_trunc('second', ts))) AS ts, "
           "CAST(timezone('America/New_York', timezone('UTC', date_trunc('second', ts))) AS DATE) AS day, value AS open, "
           "value AS high, value AS low, value AS close, 1.0::DOUBLE AS volume FROM events WHERE event_id % 97 <> 0)"))
simple("ingest_watermark", lambda t: src.ingest_start(t.daily.where(F.col("ticker") != "click").withColumn("ts", F.col("day").cast("timestamp_ntz")), t.universe, "7 days", "2015-01-01"), "ticker last_ts start",
       (
           "(SELECT u.ticker, x.last_ts, coalesce(x.last_ts - INTERVAL 7 DAYS, TIMESTAMP '2015-01-01') AS start "
           "FROM (SELECT DISTINCT event_type AS ticker FROM events) u LEFT "
           "JOIN (SELECT ticker, max(day)::TIMESTAMP AS last_ts FROM d WHERE ticker <> 'click' "
           "GROUP BY 1) x USING (ticker))"))
simple("lookback_days", lambda t: src.expand_lookback(t.universe, date(DAY), 5), "ticker day", (
    "(SELECT ticker, CAST(DATE '2024-01-20' - CAST(range AS INTEGER) AS DATE) AS day "
    "FROM (SELECT DISTINCT event_type AS ticker FROM events), range(6))"))
_OLD, _NEW = "event_id % 2 = 0", "event_id % 3 = 0"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = t.raw("events").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("close"))
    old, new = rows.where(F.col("seq") % 2 == 0), rows.where(F.col("seq") % 3 == 0)
    return old, new, clean.merge_dedupe(old, new)


_MERGED = ("(SELECT ticker, ts, seq, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY src DESC, seq DESC) AS n FROM ("
           f"SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, event_id AS seq, value AS close, 0 AS src FROM events WHERE {_OLD} UNION ALL SELECT event_type, date_trunc('hour', ts), event_id, value, 1 FROM events WHERE {_NEW})) WHERE n = 1)")
simple("merge_dedupe", lambda t: _halves(t)[2], "ticker ts seq close*", _MERGED)
simple("ingest_audit", lambda t: src.ingest_audit(*_halves(t)), "ticker rows_before# rows_fetched# rows_after# last_ts",
       (
           f"(SELECT ticker, count(*) AS rows_after, max(ts) AS last_ts FROM {_MERGED} GROUP BY 1) "
           f"JOIN (SELECT event_type AS ticker, count(*) FILTER ({_OLD}) AS rows_before, "
           f"count(*) FILTER ({_NEW}) AS rows_fetched FROM events GROUP BY 1) USING (ticker)"))
simple("latest_snapshot", lambda t: src.latest_by_ticker(t.daily), "ticker day close*", "d", "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1")
simple("retention_filter", lambda t: (lambda kept, gone: kept.crossJoin(F.broadcast(gone)))(*src.apply_retention(t.bars, F.lit("2024-01-31").cast("date"), 10)), "ticker ts close* deleted#",
       (
           "(SELECT * FROM b, (SELECT count(*) AS deleted FROM (SELECT DISTINCT ticker, day FROM b "
           "WHERE day < DATE '2024-01-21')) WHERE day >= DATE '2024-01-21')"))
simple("asof_partition", lambda t: src.asof_partition(t.daily.where(F.col("day") != date(DAY)), date(DAY)), "ticker day close*", "d", "WHERE day < DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1")

# cleaning
simple("last_timestamp", lambda t: clean.last_timestamp(t.raw("events").select(F.col("event_type").alias("ticker"), F.col("ts").cast("string").alias("ts"))), "ticker last_ts", "(SELECT ticker, max(ts) AS last_ts FROM ticks GROUP BY 1)")
simple("to_market_tz", lambda t: t.raw("events").select("event_id", C.to_market_tz(F.col("ts")).alias("local_ts")), "event_id local_ts=ts", "(SELECT seq AS event_id, ts FROM ticks)")
simple("label_session", lambda t: t.ticks.select("seq", C.label_session(F.col("ts")).alias("session")), "seq session",
       (
           "(SELECT seq, CASE WHEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) BETWEEN 14400 AND 34199 THEN 'PRE' WHEN "
           "hour(ts) * 3600 + minute(ts) * 60 + second(ts) BETWEEN 34200 AND 57599 THEN 'RTH' WHEN hour(ts) * 3600 + "
           "minute(ts) * 60 + second(ts) BETWEEN 57600 AND 71999 THEN 'AFT' ELSE 'CLOSED' END AS session FROM ticks)"))
simple("trading_day_filter", lambda t: t.ticks.where(C.trading_day(F.col("ts")) == date(DAY)), "ticker ts price* seq", "ticks", "WHERE CAST(ts AS DATE) = DATE '2024-01-20'")
simple("floor_5m", lambda t: clean.floor_grid(t.ticks), "ticker ts price* seq", (
    "(SELECT ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, price, seq FROM ticks "
    "QUALIFY row_number() OVER (PARTITION BY ticker, time_bucket(INTERVAL 5 MINUTE, ts) ORDER BY ticks.ts DESC, "
    "seq DESC) = 1)"))


def _spoiled(t: Tables) -> DataFrame:
    """Bars of whole hours, some with high and low exchanged, in order of the last event."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return t.raw("events").select(F.col("event_type").alias("ticker"), hour.alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("open"), F.col("value").alias("close"),
                                  F.col("value").alias("low"), (F.col("value") - F.when(F.col("event_id") % 50 == 0, 1.0).otherwise(0.0)).alias("high"), F.when(F.col("event_id") % 70 != 0, 1.0).alias("volume"))


simple("validate_report", lambda t: clean.validation_report(_spoiled(t)), "ticker rows# monotonic_ts duplicate_ts# bad_ohlc_rows#",
       (
           "(SELECT ticker, count(*) AS rows, bool_and(ok) AS monotonic_ts, count(*) - count(DISTINCT h) AS duplicate_ts, "
           "count(*) FILTER (event_id % 50 = 0) AS bad_ohlc_rows FROM (SELECT event_type AS ticker, date_trunc('hour', "
           "ts) AS h, event_id, coalesce(date_trunc('hour', ts) >= lag(date_trunc('hour', "
           "ts)) OVER (PARTITION BY event_type ORDER BY event_id), true) AS ok FROM events) GROUP BY 1)"))
simple("validate_enforce", lambda t: (lambda good, bad: good.withColumn("reason", F.lit("ok")).unionByName(bad))(*clean.split_valid(_spoiled(t))).groupBy("ticker", "reason").agg(F.count("*").alias("rows")), "ticker reason rows#",
       (
           "(SELECT event_type AS ticker, CASE WHEN event_id % 50 = 0 THEN 'bad prices' WHEN event_id % 70 = 0 THEN 'no "
           "volume' ELSE 'ok' END AS reason, count(*) AS rows FROM events GROUP BY 1, 2)"))
simple("clean_daily", lambda t: clean.clean_daily(t.daily.withColumn("close", F.when(F.dayofmonth("day") == 5, "NaN").when(F.dayofmonth("day") == 6, "x").otherwise(F.col("close").cast("string")))), f"ticker day {BAR}", "d", "WHERE day(day) NOT IN (5, 6)")
simple("safe_float", lambda t: t.raw("events").select("event_id", C.safe_float(F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 7 == 0, "?").otherwise(F.col("value").cast("string"))).alias("x")), "event_id x*",
       "(SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN value END AS x FROM events)")

# session state
simple("session_agg", lambda t: t.agg, "ticker day session high* low* close* bar_count# first_ts last_ts", "agg")
simple("typical_price", lambda t: t.bars.withColumn("tp", C.typical_price(F.col("high"), F.col("low"), F.col("close"))), "ticker ts tp*", "(SELECT ticker, ts, (high + low + close) / 3.0::DOUBLE AS tp FROM b)")
simple("session_vwap", lambda t: session.session_vwap(t.bars), "ticker day session sum_pv* sum_v* vwap*", "agg", "WHERE session = 'RTH'")
simple("running_vwap", lambda t: session.running_vwap(t.bars), "ticker ts running_vwap*",
       (
           "(SELECT ticker, ts, sum((high + low + close) / 3.0::DOUBLE * volume) OVER w / sum(volume) OVER w AS "
           "running_vwap FROM b WINDOW w AS (PARTITION BY ticker, day, session ORDER BY ts ROWS UNBOUNDED PRECEDING))"))
simple("opening_range", lambda t: session.opening_range(t.bars), "ticker day minutes# start_ts end_ts high* low* complete", "opening")
simple("session_state_wide", lambda t: t.state, "ticker day " + " ".join(f"{s}_{c}{'#' if c == 'bar_count' else '*'}" for s in ("pre", "rth", "aft") for c in ("high", "low", "close", "bar_count", "vwap")), "state")
simple("state_status", lambda t: session.state_status(t.universe.select("ticker").join(t.bars.where((F.col("day") == date(DAY)) & (F.hour("ts") < 12) & (F.col("ticker") != "click")).groupBy("ticker").agg(F.max("ts").alias("last_update_ts")), "ticker", "left").withColumn("day", date(DAY)), t.bars, date(DAY)),
       "ticker bars# new_bars# status", (
           "(SELECT ticker, count(*) AS bars, count(*) FILTER (ticker = 'click' OR hour(ts) >= 12) AS new_bars, "
           "CASE WHEN count(*) FILTER (ticker = 'click' OR hour(ts) >= 12) = 0 THEN 'up_to_date' ELSE 'updated' END AS "
           "status FROM b WHERE day = DATE '2024-01-20' GROUP BY 1)"))
simple("state_merge", lambda t: session.merge_state(session.session_agg(t.kept_bars.where(F.hour("ts") < 12)), t.kept_bars), "ticker day session high* low* close* bar_count# first_ts last_ts vwap*", "agg")
simple("state_last_price", lambda t: t.state.withColumn("last", session.last_price(F.col("rth_close"), F.col("pre_close"))), "ticker day last*", "ctx")

# levels
simple("true_range", lambda t: levels.atr(t.daily), "ticker day true_range*", "atr")
simple("atr", lambda t: levels.atr(t.long_daily), "ticker day true_range* atr*", "latr")
simple("prior_day", lambda t: levels.prior_day(t.kept_daily, t.state.select("ticker", "day")), "ticker day asof_day high* low* close*", "pday")
simple("prior_week", lambda t: levels.prior_week(t.kept_daily, t.state.select("ticker", "day")), "ticker day asof_day high* low* close*", "pweek")
simple("swing_pivots", lambda t: levels.swing_pivots(t.kept_daily, t.state.select("ticker", "day")), "ticker day side price* pivot_day", "pivots")
simple("pivot_filter", lambda t: levels.pivot_filter(levels.swing_pivots(t.kept_daily, t.state.select("ticker", "day")), t.parts["context"]), "ticker day side price* pivot_day", "pfil")
simple("pivot_topn", lambda t: levels.pivot_topn(levels.pivot_filter(levels.swing_pivots(t.kept_daily, t.state.select("ticker", "day")), t.parts["context"])), "ticker day side price* no# id", "ptop")
simple("zone_half_width", lambda t: levels.atr(t.long_daily).withColumn("half", C.zone_half_width(F.col("close"), F.col("atr"))), "ticker day half*", (
    "(SELECT ticker, day, greatest(close * 0.0008::DOUBLE, CASE WHEN atr > 0 THEN atr * 0.2::DOUBLE END) AS half "
    "FROM latr)"))
_LEVEL = "ticker day id kind source session price* strength#"
simple("make_levels", lambda t: levels.day_levels(levels.prior_day(t.kept_daily, t.state.select("ticker", "day"))).unionByName(levels.week_levels(levels.prior_week(t.kept_daily, t.state.select("ticker", "day")))), _LEVEL, "(SELECT * FROM lv_day UNION ALL SELECT * FROM lv_week)")
simple("state_levels", lambda t: levels.state_levels(t.state, session.opening_range(t.kept_bars)), _LEVEL, "lv_state")


def _union(t: Tables) -> DataFrame:
    days, p = t.state.select("ticker", "day"), t.parts
    top = levels.pivot_topn(levels.pivot_filter(levels.swing_pivots(t.kept_daily, days), p["context"]))
    return levels.levels_union(levels.day_levels(levels.prior_day(t.kept_daily, days)), levels.week_levels(levels.prior_week(t.kept_daily, days)), levels.pivot_levels(top), levels.state_levels(p["state"], p["opening"]))


simple("levels_union", _union, _LEVEL + " ord#", "lv_all")
simple("levels_dedupe", lambda t: levels.levels_dedupe(_union(t)), _LEVEL + " pos#", "lv_one")
simple("levels_topk", lambda t: levels.levels_topk(levels.levels_dedupe(_union(t)), t.parts["context"]), _LEVEL + " rank#", "lv_top")
simple("levels", lambda t: t.parts["levels"], _LEVEL + " rank# zone_low* zone_high* atr* last*", "lv")

# features
for _k, _c in (("rv_5m", "rv"), ("er_5m", "er"), ("overlap_5m", "overlap"), ("dist_vwap_atr", "dist_vwap_atr"), ("pos_rth_range", "pos_rth_range")):
    simple(_k, lambda t: t.parts["features"], f"ticker ts {_c}*", "f5")
simple("features_5m", lambda t: t.parts["features"], "ticker day ts session rv* er* overlap* dist_vwap_atr* pos_rth_range*", "f5")
simple("features_5m_latest", lambda t: t.parts["latest"], "ticker day asof_ts last_price* session rv* er* overlap* dist_vwap_atr* pos_rth_range*", "f5l")
simple("level_pressure", lambda t: features.level_pressure(t.kept_bars, t.parts["levels"]), "ticker day ts pressure*", "press")
for _k, _c in (("daily_atr", "atr"), ("daily_rv", "rv"), ("daily_er", "er"), ("slope_close", "slope_close"), ("pos_hhll", "pos_hhll"), ("vol_z", "vol_z"), ("range_atr", "range_atr"), ("gap_atr", "gap_atr")):
    simple(_k, lambda t: t.long_features, f"ticker day {_c}*", "ldf")
_DAILY = f"ticker day {BAR} atr* rv* er* slope_close* pos_hhll* vol_z* range_atr* gap_atr*"
simple("features_daily", lambda t: t.long_features, _DAILY, "ldf", "WHERE n_rows >= 60")
simple("features_daily_latest", lambda t: features.features_daily_latest(t.long_features), _DAILY, "ldf", "WHERE n_rows >= 60 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1")

# regimes
_L = "ticker day close* er* slope_n* range_atr* regime"
simple("slope_norm", lambda t: t.long_features.withColumn("slope_n", regimes.slope_norm()), "ticker day slope_n*", "ldr")
simple("regime_label", lambda t: regimes.label_regimes(t.long_features), _L, "ldr")
simple("regime_changed", lambda t: regimes.label_regimes(t.long_features), "ticker day regime_prev changed", "ldr")
simple("regime_asof", lambda t: regimes.regime_asof(regimes.label_regimes(t.long_features), date(AS_OF)), "ticker rows# asof_label_day asof_regime", (
    "(SELECT ticker, count(*) AS rows, max(day) AS asof_label_day, arg_max(regime, day) AS asof_regime FROM ldr "
    "WHERE day <= DATE '1998-06-30' GROUP BY 1)"))
simple("regime_latest", lambda t: regimes.regime_latest(regimes.label_regimes(t.long_features), date(AS_OF)), _L + " changed", "ldr", "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day = DATE '1998-06-30' DESC, day DESC) = 1")

# nowcast
simple("infer_session", lambda t: t.parts["latest"].withColumn("inferred", nowcast.infer_session(F.col("asof_ts"), F.col("day"))), "ticker day asof_ts inferred",
       (
           "(SELECT ticker, day, asof_ts, CASE WHEN x >= 14400 AND x < 34200 THEN 'PRE' WHEN x >= 34200 AND x < 57600 THEN "
           "'RTH' WHEN x >= 57600 AND x < 72000 THEN 'AFT' ELSE 'UNK' END AS inferred "
           "FROM (SELECT *, epoch(asof_ts - day::TIMESTAMP) AS x FROM f5l))"))
simple("session_end", lambda t: t.parts["features"].withColumn("end_ts", nowcast.session_end(F.col("session"), F.col("day"))), "ticker ts session end_ts",
       (
           "(SELECT ticker, ts, session, day::TIMESTAMP + to_seconds(CASE session WHEN 'PRE' THEN 34200 WHEN 'AFT' THEN "
           "72000 ELSE 57600 END) AS end_ts FROM f5)"))
simple("bars_remaining", lambda t: t.parts["features"].withColumn("bars_remaining", nowcast.bars_remaining(F.col("ts"), nowcast.session_end(F.col("session"), F.col("day")))), "ticker ts bars_remaining#",
       (
           "(SELECT ticker, ts, greatest(ceil(epoch(day::TIMESTAMP + to_seconds(CASE session WHEN 'PRE' THEN 34200 WHEN "
           "'AFT' THEN 72000 ELSE 57600 END) - ts) / 60.0::DOUBLE / 5), 0) AS bars_remaining FROM f5)"))


def _as_inputs(t: Tables) -> DataFrame:
    """Every bar as an as-of time of the nowcast, so that its rows grow with the bars."""
    f = t.parts["features"].select("ticker", "day", F.col("ts").alias("asof_ts"), F.col("close").alias("last_price"), "session", "rv", "er", "overlap", "dist_vwap_atr", "pos_rth_range")
    return nowcast.nowcast_today_range(nowcast.nowcast_inputs(f, t.parts["state"], t.parts["context"]))


@register("ushape_weights", query((
    "SELECT b.ticker, b.ts, CAST(u.bar_index AS BIGINT) AS bar_index, "
    "floor((u.weight) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS weight, "
    "floor((u.remaining) * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS remaining FROM b "
    "JOIN u ON u.bar_index = (hour(ts) * 60 + minute(ts) - 570) // 5 WHERE session = 'RTH'")))
def ushape_weights(t: Tables) -> DataFrame:
    """The weight of every RTH bar."""
    index = F.floor((C.seconds_of_day(F.col("ts")) - C.RTH_OPEN) / 300)
    dim = nowcast.ushape_weights(t.spark)
    return t.bars.where("session = 'RTH'").withColumn("bar_index", index).join(F.broadcast(dim), "bar_index").select("ticker", "ts", "bar_index", "weight", "remaining")


_T = {"remaining_var_frac": "bars_remaining# remaining_var_frac*", "sigma_intraday": "sigma_intraday*", "sigma_atr": "sigma_atr*", "blend_weight": "blend_weight*", "sigma_blend": "sigma_pts* sigma_source",
      "remaining_bands": "rem_low_68* rem_high_68* rem_width_68* rem_low_95* rem_high_95* rem_width_95*", "conditional_extremes": "low_so_far* high_so_far* day_low_68* day_high_68* day_width_68* day_low_95* day_high_95* day_width_95*"}
for _k, _c in _T.items():
    simple(_k, lambda t: t.today, f"ticker day asof_ts session {_c}", "today")
simple("today_range", lambda t: t.today, "ticker day asof_ts session last_price* rv* atr* is_stale " + " ".join(_T.values()), "today")
simple("today_range_every_bar", _as_inputs, "ticker day asof_ts session last_price* bars_remaining# sigma_pts* sigma_source rem_low_68* rem_high_68*", "e_today")

# insights
simple("zone_distance", lambda t: t.parts["levels"].withColumn("dist", insights.zone_distance(F.col("last"), F.col("zone_low"), F.col("zone_high"))), "ticker day rank# dist*", "(SELECT ticker, day, rank, greatest(zone_low - last, last - zone_high, 0.0::DOUBLE) AS dist FROM lv)")
simple("nearest_levels", lambda t: (lambda p: insights.nearest_levels(nowcast.nowcast_today_range(p["inputs"]), p["levels"]))(t.parts),
       "ticker day " + " ".join(f"{s}_{c}" for s in ("sup", "res") for c in ("dist*", "id", "kind", "source", "zone_low*", "zone_high*", "strength#")), "nl")
simple("zone_strength", lambda t: t.parts["levels"].withColumn("share", insights.zone_strength(F.col("strength"))), "ticker day rank# share*", (
    "(SELECT ticker, day, rank, coalesce(least(greatest((strength - 1) / 4.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), "
    "0.0::DOUBLE) AS share FROM lv)"))
_I = {"level_distance_atr": "sup_dist_atr* res_dist_atr* sup_name res_name", "tape_scores": "sigma_rem_atr* trend* chop* vol*", "near_scores": "near_sup* near_res* near_any* inside_bonus*",
      "likelihoods": "pos_68* stall* breakout_up* breakout_down*", "guidance": "trade_bias directional_premium_allowed prefer_spreads mean_reversion_preferred avoid_trading"}
for _k, _c in _I.items():
    simple(_k, lambda t: t.insights, f"ticker day {_c}", "i9")
_CTX = " ".join(f"ctx_low_{n}* ctx_high_{n}* pos_in_{n}*" for n in ("45", "68", "95"))
simple("range_context", lambda t: t.insights, f"ticker day {_CTX}", "rc")
simple("central_bands", lambda t: insights.central_bands(t.today), "ticker day prob* z* low* high*", "cb")
register("rationale", query("SELECT ticker, day, array_to_string(notes, '; ') AS rationale FROM why"))(lambda t: t.insights.select("ticker", "day", F.array_join("rationale", "; ").alias("rationale")))
register("insights", select("ticker day asof_ts session last_price* atr* bars_remaining# " + " ".join(_I.values()) + " " + _CTX + " rationale=array_to_string(notes,';')", "rc"))(
    lambda t: t.insights.select("ticker", "day", "asof_ts", "session", "last_price", "atr", "bars_remaining", *[c.rstrip("*#") for c in " ".join([*_I.values(), _CTX]).split()], F.array_join("rationale", ";").alias("rationale")))

# end of day
_B = " ".join(f"low_{n}* high_{n}*" for n in ("45", "68", "95"))
simple("tomorrow_range", lambda t: eod.tomorrow_range(t.features, t.labels), f"ticker day close* atr* regime status sigma_pts* {_B}", "tom")
simple("next_session", lambda t: eod.next_session(t.daily), "ticker day next_day", "tom")


@register("next_session_calendar", query((
    "SELECT a.ticker, a.day, coalesce(min(c.day), a.day + CASE isodow(a.day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) "
    "AS next_day FROM d a LEFT JOIN (SELECT DISTINCT day FROM d "
    "WHERE isodow(day) < 6 AND day <> DATE '2024-01-15') c ON c.day > a.day AND c.day <= a.day + 14 GROUP BY 1, 2")))
def next_session_calendar(t: Tables) -> DataFrame:
    """Sessions from a calendar: weekdays of the data but one holiday."""
    calendar = t.kept_daily.select("day").distinct().where(F.weekday("day") < 5).where(F.col("day") != F.lit("2024-01-15").cast("date"))
    return eod.next_session(t.kept_daily, calendar).select("ticker", "day", "next_day")


simple("key_levels", lambda t: eod.key_levels(t.parts["levels"], t.features.select("ticker", "day", F.col("close").alias("px"))), "ticker day side place# id kind source zone_low* zone_high* strength# dist_pts*", "kl")
register("risk_notes", query("SELECT ticker, day, array_to_string(note_list, '; ') AS risk_notes FROM notes"))(lambda t: eod.tomorrow_range(t.features, t.labels).select("ticker", "day", F.array_join(eod.risk_notes(), "; ").alias("risk_notes")))
_PLAN = query((
    f"SELECT n.ticker, n.day, next_day, regime, "
    f"status, {', '.join(f'floor({c} * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE AS {c}' for c in ('close', 'sigma_pts', *(x.rstrip('*') for x in _B.split())))}, array_to_string(note_list, '; ') AS risk_notes, coalesce(supports, '') AS supports, coalesce(resistances, '') AS resistances FROM notes n LEFT JOIN (SELECT ticker, day, string_agg(id, ',' ORDER BY place) FILTER (side = 'support') AS supports, string_agg(id, ',' ORDER BY place) FILTER (side = 'resistance') AS resistances FROM kl GROUP BY 1, 2) k USING (ticker, day)"))


def _plan(df: DataFrame) -> DataFrame:
    ids = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["id"]), ","), F.lit("")).alias(c)
    return df.select("ticker", "day", "next_day", "regime", "status", "close", "sigma_pts", *[x.rstrip("*") for x in _B.split()], F.array_join("risk_notes", "; ").alias("risk_notes"), ids("supports"), ids("resistances"))


register("eod_plan", _PLAN)(lambda t: _plan(eod.eod_plan(t.features, t.labels, t.parts["levels"])))
register("eod_pipeline", _PLAN)(lambda t: _plan(pipelines.eod_pipeline(t.kept_daily, t.parts["levels"], min_rows=1)))
ORACLES["intraday_pipeline"] = ORACLES["insights"]
register("intraday_pipeline", ORACLES["insights"])(lambda t: pipelines.intraday_pipeline(t.ticks).select("ticker", "day", "asof_ts", "session", "last_price", "atr", "bars_remaining", *[c.rstrip("*#") for c in " ".join([*_I.values(), _CTX]).split()], F.array_join("rationale", ";").alias("rationale")))


def _raw_ingest(t: Tables) -> DataFrame:
    """A stored table of half of the events, into which a third of them is upserted; read back."""
    e = t.raw("events")
    raw = e.select(F.concat(F.lit("$"), F.upper("event_type")).alias("symbol"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Datetime"), *[F.col("value").cast("string").alias(c) for c in ("Open", "High", "Low", "Close")], F.lit("1").alias("Volume"))
    path, rows = t.scratch("ingested"), pipelines.normalized(raw.where("seq % 2 = 0"), t.universe)[0]
    src.write_bars(rows, path)
    pipelines.ingest_into(raw.where("seq % 3 = 0"), path, t.universe, rows.schema)
    return src.scan_bars(t.spark, path, rows.schema)


_FLOORED = (
    "SELECT ticker, bts AS ts, seq, price, src FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS bts, "
    "row_number() OVER (PARTITION BY ticker, time_bucket(INTERVAL 5 MINUTE, ts) ORDER BY ts DESC, seq DESC) AS n "
    "FROM (SELECT *, {0} AS src FROM ticks WHERE seq % {1} = 0)) WHERE n = 1")
simple("ingest_pipeline", lambda t: _raw_ingest(t).withColumn("price", F.col("close")), "ticker ts seq price*",
       (
           f"(SELECT * FROM ({_FLOORED.format(0, 2)} UNION ALL {_FLOORED.format(1, 3)}) "
           f"QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY src DESC, seq DESC) = 1)"))
simple("ticker_status", lambda t: pipelines.ticker_status(t.universe, bars=t.kept_bars.where("ticker <> 'click'"), labels=t.labels.where("regime = 'high_vol'")), "ticker status reason",
       (
           "(SELECT DISTINCT event_type AS ticker, CASE WHEN event_type = 'click' THEN 'error' WHEN h.ticker IS NULL THEN "
           "'error' ELSE 'ok' END AS status, CASE WHEN event_type = 'click' THEN 'no bars' WHEN h.ticker IS NULL THEN 'no "
           "labels' END AS reason FROM events LEFT JOIN (SELECT DISTINCT ticker FROM dr "
           "WHERE regime = 'high_vol') h ON h.ticker = event_type)"))




def _faults(t: Tables) -> DataFrame:
    """One ticker keeps its bad rows; the others run on."""
    rows = _spoiled(t).where((F.col("ticker") == "click") | ((F.col("seq") % 50 != 0) & (F.col("seq") % 70 != 0)))
    sound, faults = pipelines.isolate(rows)
    return pipelines.ticker_status(t.universe, faults=faults, bars=sound)


simple("ticker_faults", _faults, "ticker status reason",
       (
           "(SELECT DISTINCT event_type AS ticker, CASE WHEN event_type = 'click' THEN 'error' ELSE 'ok' END AS status, "
           "CASE WHEN event_type = 'click' THEN 'bad prices' END AS reason FROM events)"))


# localization
def _values_sql(rows: tuple, names: str) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in rows) + f") AS v({names})"


_PAYLOAD = ["last_price", "atr", "sigma_pts", "rv", "er"]
register("localized_fields", query((
    "SELECT p.ticker, p.day, p.field, coalesce(CASE WHEN en = zh OR zh IS NULL THEN en ELSE en || '/' || zh END, "
    "p.field) AS label, CAST(p.known AS BOOLEAN) AS known FROM (SELECT ticker, day, unnest(['last_price', 'atr', "
    "'sigma_pts', 'rv', 'er']) AS field, unnest([last_price IS NOT NULL, atr IS NOT NULL, sigma_pts IS NOT NULL, "
    "rv IS NOT NULL, er IS NOT NULL]) AS known FROM today) p LEFT JOIN ") + _values_sql(localize.FIELDS, "field, en, zh") + " ON v.field = p.field"))(
    lambda t: localize.localize_fields(localize.unpivoted(t.today, ("ticker", "day"), _PAYLOAD), localize.field_labels(t.spark)).select("ticker", "day", "field", "label", F.col("value").isNotNull().alias("known")))
register("localized_values", query((
    "SELECT l.ticker, l.day, CAST(l.rank AS BIGINT) AS rank, l.kind AS value, "
    "CASE WHEN en = zh THEN en ELSE en || '/' || zh END AS text FROM lv l LEFT JOIN ") + _values_sql(localize.VALUES, "what, value, en, zh") + " ON v.what = 'kind' AND v.value = l.kind"))(
    lambda t: localize.localize_values(t.parts["levels"].select("ticker", "day", "rank", F.lit("kind").alias("what"), F.col("kind").alias("value")), localize.value_labels(t.spark)).select("ticker", "day", "rank", "value", "text"))
register("localized_notes", query((
    "SELECT ticker, day, note, CASE WHEN en = zh THEN en ELSE replace(replace(en, '{0}', coalesce(split_part(note, "
    "'|', 2), '')), '{1}', coalesce(split_part(note, '|', 3), '')) || ' / ' || replace(replace(zh, '{0}', "
    "coalesce(split_part(note, '|', 2), '')), '{1}', coalesce(split_part(note, '|', 3), '')) END AS text "
    "FROM (SELECT ticker, day, unnest(notes) AS note FROM why) LEFT JOIN ") + _values_sql(localize.TEMPLATES, "k, en, zh") + " ON v.k = split_part(note, '|', 1)"))(
    lambda t: localize.localize_rationale(t.insights.select("ticker", "day", F.explode("rationale").alias("note"))))
_REGIMES = tuple((value, zh) for what, value, _, zh in localize.VALUES if what == "regime")
register("localized_risk_notes", query(
    "SELECT ticker, day, item, replace(n.en, '{0}', coalesce(split_part(item, '|', 2), '')) || ' / ' "
    "|| replace(n.zh, '{0}', coalesce(r.rzh, split_part(item, '|', 2), '')) AS text "
    "FROM risk_items LEFT JOIN " + _values_sql(localize.RISK_NOTES, "k, en, zh").replace("AS v(", "AS n(") + " ON n.k = split_part(item, '|', 1) "
    "LEFT JOIN " + _values_sql(_REGIMES, "rk, rzh").replace("AS v(", "AS r(") + " ON r.rk = split_part(item, '|', 2)"))(
    lambda t: localize.localize_notes(eod.tomorrow_range(t.features, t.labels).select("ticker", "day", F.explode(eod.note_items()).alias("item"))))

# training
simple("training_set", lambda t: (lambda f: ml.training_set(f, regimes.label_regimes(f)))(t.long_features), "ticker day regime close* er*", "ts0")
register("feature_columns", query((
    "SELECT unnest(['atr', 'rv', 'er', 'slope_close', 'pos_hhll', 'vol_z', 'range_atr', 'gap_atr']) AS name, "
    "unnest([count(atr), count(rv), count(er), count(slope_close), count(pos_hhll), count(vol_z), count(range_atr), "
    "count(gap_atr)]) AS rows FROM ts0")))(
    lambda t: (lambda df, names: df.agg(*[F.count(c).alias(c) for c in names]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("rows")) for c in names])).alias("x")).select("x.*"))(t.training, ml.feature_columns(t.training)))
simple("time_split", lambda t: t.training, "ticker day split", "ts")
simple("split_ranges", lambda t: ml.split_ranges(t.training), "ticker split start_day end_day rows#", "(SELECT ticker, split, min(day) AS start_day, max(day) AS end_day, count(*) AS rows FROM ts GROUP BY 1, 2)")
simple("class_weights", lambda t: ml.class_weights(t.training.where("split = 'train'")).select("ticker", "regime", "weight").distinct(), "ticker regime weight*",
       (
           "(SELECT ticker, regime, sum(count(*)) OVER (PARTITION BY ticker) / (count(*) OVER (PARTITION BY ticker) * "
           "count(*)::DOUBLE) AS weight FROM ts WHERE split = 'train' GROUP BY 1, 2)"))
_COLS = ("rv", "er", "slope_close", "pos_hhll", "vol_z", "range_atr", "gap_atr")


def _fitted(t: Tables, weighted: bool = False) -> DataFrame:
    rows = t.training
    train = rows.where("split = 'train'")
    model = ml.fit_regime(ml.class_weights(train) if weighted else train, _COLS, weighted=weighted)
    return ml.predict(model, rows.where("split = 'holdout'"))


register("regime_model")(lambda t: ml.metrics(_fitted(t, True)))
register("predict_regime")(_fitted)


@register("regime_models_all")
def regime_models_all(t: Tables) -> DataFrame:
    """A model a ticker, all fitted in one job, and its metrics on the ticker's holdout."""
    models = stored(ml.fit_all(t.training.where("split = 'train'"), _COLS, weighted=True), "models")
    return ml.metrics(ml.predict_all(models, t.training.where("split = 'holdout'"), _COLS))


_HIT = (
    "(SELECT ticker, sum(hits) / sum(n)::DOUBLE AS accuracy, avg(hits / n::DOUBLE) AS balanced_accuracy, "
    "sum(n) AS rows FROM (SELECT ticker, regime, count(*) FILTER (regime = prediction) AS hits, count(*) AS n "
    "FROM pred GROUP BY 1, 2) GROUP BY 1)")
simple("accuracy", lambda t: ml.metrics(t.predictions), "ticker accuracy* rows#", _HIT)
simple("balanced_accuracy", lambda t: ml.metrics(t.predictions), "ticker balanced_accuracy* rows#", _HIT)
simple("confusion_matrix", lambda t: ml.confusion(t.predictions), "ticker regime prediction n#", "conf")
simple("classification_report", lambda t: ml.class_report(t.predictions), "ticker label precision* recall* f1* support#",
       (
           "(SELECT * FROM rep UNION ALL SELECT ticker, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) "
           "FROM rep GROUP BY 1 UNION ALL SELECT ticker, 'weighted avg', sum(precision * support) / sum(support), "
           "sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rep GROUP BY 1)"))
def _registered(t: Tables) -> DataFrame:
    """Two commits of the same models, and what is loaded then."""
    table = ModelTable(t.spark, t.scratch("registry"))
    rows = ml.metrics(t.predictions).select(F.concat(F.lit("regime_"), "ticker").alias("model"), F.lit("2001-12-31").cast("date").alias("asof_day"), "accuracy")
    for version in ("v1", "v2"):
        table.commit(rows.withColumn("version", F.lit(version)), table.version())
    return table.load(F.lit("2001-12-31").cast("date"))


simple("model_registry", _registered, "model version asof_day accuracy*",
       f"(SELECT 'regime_' || ticker AS model, 'v2' AS version, DATE '2001-12-31' AS asof_day, accuracy FROM {_HIT})")


_NIGHTS = 3


@register("features_nightly", select("ticker day atr* rv* er* slope_close* pos_hhll* vol_z* range_atr* gap_atr*", "df", f"WHERE day > (SELECT max(day) - {_NIGHTS} FROM d)"))
def features_nightly(t: Tables) -> DataFrame:
    """Features of the last days by nightly runs, each from its own partition and the tail of the run before."""
    daily, out, tail = t.scratch("daily"), t.scratch("nightly"), t.scratch("tail")
    src.write_bars(t.kept_daily, daily)
    last = t.kept_daily.agg(F.max("day")).first()[0]
    days = [r.day for r in t.kept_daily.select("day").distinct().orderBy("day").collect()]
    first = [d for d in days if (last - d).days >= _NIGHTS]
    seed = t.kept_daily.where(F.col("day") <= F.lit(first[-1])) if first else t.kept_daily.limit(0)
    nightly.leave_tail(seed, tail, str(first[-1]) if first else "0001-01-01")
    for day in days[len(first):]:
        nightly.nightly(t.spark, daily, out, tail, str(day))
    return src.scan_bars(t.spark, out, nightly.features_schema()).drop("open", "high", "low", "close", "volume")


# streams: a run over all that is there, as a table
def _streamed(t: Tables, frame: DataFrame, keys: tuple[str, ...], make, mode: str) -> DataFrame:
    """Writes frame as files in order of time, streams them and returns the newest row of each key."""
    path, out = t.scratch("arrivals"), t.scratch("stream")
    frame.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    source = t.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 100).parquet(path)

    run = make(source).writeStream.outputMode(mode).option("checkpointLocation", t.scratch("offsets")).foreachBatch(sinks.batch_sink(out)).trigger(availableNow=True).start()
    run.awaitTermination()
    return sinks.newest_rows(sinks.read_sink(t.spark, out), *keys)


simple("stream_session_state", lambda t: _streamed(t, t.bars.drop("session", "day"), ("ticker", "day", "session"), streams.stream_session_state, "update"), "ticker day session high* low* close* bar_count# vwap*", "agg")
simple("stream_dedupe", lambda t: _streamed(t, t.kept_bars.drop("session", "day").union(t.kept_bars.drop("session", "day")), ("ticker", "ts"), streams.stream_dedupe, "append"), "ticker ts close*", "b")


@register("stream_tumbling_bars", select(f"ticker ts {BAR}", "b", "WHERE ts + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 60 MINUTE FROM ticks)"))
def stream_tumbling_bars(t: Tables) -> DataFrame:
    """Bars whose end the watermark has passed; a bar of the last hour may still change."""
    out = _streamed(t, t.ticks, ("ticker", "ts"), streams.stream_bars, "append")
    last = t.ticks.agg((F.max("ts") - F.expr("INTERVAL 60 MINUTES")).alias("upto"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz")).crossJoin(F.broadcast(last)).where(F.col("ts") + F.expr("INTERVAL 5 MINUTES") <= F.col("upto")).drop("upto").select("ticker", "ts", *BAR.replace("*", "").split())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
