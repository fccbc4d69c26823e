"""Composed plans: ingest, the intraday chain, the end-of-day chain, and the status of each ticker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.operators import clean, eod, features, insights, levels, nowcast, regimes, session
from barlight.sources import bars as sources
from barlight.sources.shared import stored


def intraday_parts(bars: DataFrame, daily: DataFrame, state: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = stored) -> dict[str, DataFrame]:
    """State, opening range, context, levels, features and nowcast inputs of bars and daily bars.

    What several steps read (state, context) is a row a ticker and day and goes through `keep`, so that no step
    computes it again; bars and daily should be stored tables for the same reason. The rest is lazy.
    """
    state = keep(session.session_state(session.session_agg(bars)), "state") if state is None else state
    opening = session.opening_range(bars)
    context = keep(levels.level_context(daily, state), "context")
    ranked = levels.compute_levels(daily, state, opening, context=context)
    around = context.join(state.select("ticker", "day", "rth_vwap", "rth_high", "rth_low"), ["ticker", "day"]).drop("last")
    own = features.intraday_features(bars, around)
    latest = features.features_5m_latest(own)
    inputs = nowcast.nowcast_inputs(latest, state, context)
    return {"state": state, "opening": opening, "context": context, "levels": ranked, "features": own, "latest": latest, "inputs": inputs}


def intraday_pipeline(ticks: DataFrame, day: Column | None = None, ticker: str | None = None, width: str = "5 minutes") -> DataFrame:
    """Ticks to insights in one plan; a ticker or day only narrows what is read and returned."""
    if ticker is not None:
        ticks = ticks.where(F.col("ticker") == ticker)
    bars = stored(clean.build_bars(ticks, width), "bars")
    parts = intraday_parts(bars, stored(clean.daily_of_bars(bars), "daily"))
    today = stored(nowcast.nowcast_today_range(parts["inputs"]), "today")
    out = insights.intraday_insights(today, parts["levels"])
    return out if day is None else out.where(F.col("day") == day)


def eod_pipeline(daily: DataFrame, ranked: DataFrame, min_rows: int = features.MIN_ROWS, params: regimes.RegimeParams = regimes.RegimeParams()) -> DataFrame:
    """Daily bars to plans: features, regimes, range, key levels and notes."""
    own = features.daily_features(daily, min_rows=min_rows)
    return eod.eod_plan(own, regimes.label_regimes(own, params), ranked)


def normalized(raw: DataFrame, universe: DataFrame, first: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Provider rows (symbol, seq and provider columns) as good bars on the five-minute grid, and rejected ones."""
    known = sources.with_universe(raw, universe)
    good, bad = clean.split_valid(clean.floor_grid(sources.normalize_bars(known, "5m", keep=("ticker", "seq"))))
    return (good if first is None else good.where(F.col("day") >= first)), bad


def ingest_pipeline(raw: DataFrame, existing: DataFrame, universe: DataFrame, first: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Provider rows merged with bars that are there: bars, rejected rows, audit. ingest_into() keeps a stored table."""
    good, bad = normalized(raw, universe, first)
    merged = clean.merge_dedupe(existing, good.select(*existing.columns))
    return merged, bad, sources.ingest_audit(existing, good, merged)


def ingest_into(raw: DataFrame, path: str, universe: DataFrame, schema: T.StructType, first: Column | None = None) -> tuple[list, DataFrame]:
    """Upserts provider rows into a table partitioned by day: the days that were rewritten, and the rejected rows.

    Only the partitions of days that the new rows have are read and replaced; others keep their files. A run that finds
    the same rows again writes the same rows. The driver holds the days of one fetch.
    """
    good, bad = normalized(raw, universe, first)
    good = stored(good.select(*[f.name for f in schema]), "fetched")
    days = [r.day for r in good.select("day").distinct().collect()]
    if days:
        existing = sources.scan_bars(raw.sparkSession, path, schema).where(F.col("day").isin(days))
        sources.write_bars(clean.merge_dedupe(existing, good), path)
    return sorted(days), bad


def isolate(bars: DataFrame, require_volume: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bars of the tickers without a fault, and a row (ticker, reason, rows) for each of the others.

    A fault is a row that assert_valid() fails on, or a price that is no finite number; it takes its ticker out and no
    other. The reason is the first in alphabet.
    """
    good, bad = clean.split_valid(bars, require_volume)
    wild = " OR ".join(f"isnan({c}) OR abs({c}) = double('infinity')" for c in clean.PRICES)
    faults = bad.select("ticker", "reason").unionByName(good.where(wild).select("ticker", F.lit("price out of range").alias("reason")))
    faults = stored(faults.groupBy("ticker").agg(F.min("reason").alias("reason"), F.count("*").alias("rows")), "faults")
    return bars.join(faults, bars.ticker.eqNullSafe(faults.ticker), "left_anti"), faults


def isolated_pipeline(bars: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insights of the tickers whose bars are sound, and ok or error and why of every ticker of the universe."""
    sound, faults = isolate(bars)
    sound = stored(sound, "bars")
    parts = intraday_parts(sound, stored(clean.daily_of_bars(sound), "daily"))
    out = insights.intraday_insights(stored(nowcast.nowcast_today_range(parts["inputs"]), "today"), parts["levels"])
    return out, ticker_status(universe, faults=faults, bars=sound)


def ticker_status(universe: DataFrame, faults: DataFrame | None = None, **inputs: DataFrame) -> DataFrame:
    """ok, or error and why, of each ticker: its fault (ticker, reason), else its first missing input. One bad ticker
    holds up no other."""
    out, reason = universe.select("ticker").distinct(), F.lit(None).cast("string")
    for name, df in inputs.items():
        out = out.join(df.select("ticker").distinct().withColumn(f"has_{name}", F.lit(True)), "ticker", "left")
    for name in reversed(list(inputs)):
        reason = F.when(F.col(f"has_{name}").isNull(), f"no {name}").otherwise(reason)
    if faults is not None:
        out = out.join(faults.select("ticker", F.col("reason").alias("_fault")), "ticker", "left")
        reason = F.coalesce("_fault", reason)
    return out.select("ticker", F.when(reason.isNull(), "ok").otherwise("error").alias("status"), reason.alias("reason"))
