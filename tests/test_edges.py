"""Hand-made edges of the bar operators, and nowcasts with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlight.functions import columns as C
from barlight.operators import clean, eod, features, insights, levels, localize, ml, nowcast, regimes, session
from barlight.sources import bars as src
from barlight.sources import shared

DAY = dt.date(2024, 1, 10)
BAR = "ticker string, day date, ts timestamp_ntz, open double, high double, low double, close double, volume double, session string"

# ticker, day, as-of, session, last, rv, ATR, blend weight, low and high so far; bars, variance share, sigma, source, 68 % low, 95 % high of the day
NOWCASTS = [
    ("AAPL", "2026-01-16", "2026-01-16 19:55:00", "AFT", 255.25, 0.00018054042946052427, 4.204281398228237, 1.0, 242.3546, 255.58, 1, 0.01282051282051282, 0.42042813982282373, "blend_var", 254.82957186017717, 256.07403915405274),
    ("SPX", "2026-01-16", "2026-01-16 16:40:00", "AFT", 6940.01, 0.000397504752541351, 50.59852818080357, 1.0, 6939.58, 6940.18, 40, 0.5128205128205128, 17.447468275367143, "blend_var", 6922.562531724633, 6974.2070378197195),
    ("SPX", "2026-01-14", "2026-01-13 09:45:00", "RTH", 6975.18994140625, 0.00036873143089369135, 45.324916294642854, 0.0, None, None, 363, 0.9759753276548871, 44.77714817450788, "blend_var", 6930.412793231742, 7062.953151828286),
    ("SPY", "2026-01-14", "2026-01-14 07:35:00", "PRE", 691.79, 0.0003013858198731807, 4.547140938895089, 0.0, 690.23, 693.19, 23, 0.2948717948717949, 2.4691929713407337, "blend_var", 689.3208070286593, 696.6296182238278),
    ("SPX", "2026-01-14", "2026-01-14 09:30:00", "RTH", 6936.81982421875, None, 45.324916294642854, 0.01282051282051282, 6936.81982421875, 6936.81982421875, 78, 0.9759753276548871, 44.77714817450788, "atr_only", 6892.042676044242, 7024.583034640786),
    ("SPY", "2026-01-14", "2026-01-14 09:30:00", "RTH", 690.8599853515625, 0.0002921264049455468, 4.547140938895089, 0.01282051282051282, 690.8599853515625, 690.8599853515625, 78, 0.9759753276548871, 4.46785863817695, "blend_var", 686.3921267133856, 699.6169882823893),
    ("SPY", "2026-01-14", "2026-01-14 09:45:00", "RTH", 689.5900268554688, 0.0006980101653812501, 4.547140938895089, 0.05128205128205128, 689.4500122070312, 691.7100219726562, 75, 0.9080137742502278, 4.3246795398615125, "blend_var", 685.2653473156072, 698.0663987535974),
]


def daily(spark, closes, ticker="a", start=dt.date(2024, 1, 1)):
    rows = [(ticker, start + dt.timedelta(i), float(c), c + 1.0, c - 1.0, float(c), 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, day date, open double, high double, low double, close double, volume double")


def test_nowcasts(spark):
    rows = [(i, t, dt.date.fromisoformat(d), dt.datetime.fromisoformat(a), s, last, rv, atr, round(w * 78), lo, hi) for i, (t, d, a, s, last, rv, atr, w, lo, hi, *_) in enumerate(NOWCASTS)]
    df = spark.createDataFrame(rows, "i int, ticker string, day date, asof_ts timestamp_ntz, session string, last_price double, rv double, atr double, rth_bar_count long, low_so_far double, high_so_far double")
    got = {r.i: r for r in nowcast.nowcast_today_range(df).collect()}
    for i, case in enumerate(NOWCASTS):
        bars, share, sigma, source, low, high = case[10:]
        r = got[i]
        assert (r.bars_remaining, r.sigma_source) == (bars, source)
        assert [r.remaining_var_frac, r.sigma_pts, r.rem_low_68, r.day_high_95] == pytest.approx([share, sigma, low, high], rel=1e-9)
    assert got[2].is_stale and not got[3].is_stale


def test_nowcast_without_any_source(spark):
    df = spark.createDataFrame([("a", DAY, dt.datetime(2024, 1, 10, 3), None, 5.0, None, None, None, None, None)], "ticker string, day date, asof_ts timestamp_ntz, session string, last_price double, rv double, atr double, rth_bar_count long, low_so_far double, high_so_far double")
    r = nowcast.nowcast_today_range(df).first()
    assert r.session == "UNK" and r.sigma_pts is None and r.sigma_source is None and r.rem_low_68 is None


@pytest.mark.parametrize(("at", "want"), [("03:59:59", "CLOSED"), ("04:00:00", "PRE"), ("09:29:59.9", "PRE"), ("09:30:00", "RTH"), ("15:59:59", "RTH"), ("16:00:00", "AFT"), ("19:59:59", "AFT"), ("20:00:00", "CLOSED")])
def test_session_bounds(spark, at, want):
    assert spark.range(1).select(C.label_session(F.lit(f"2024-01-10 {at}").cast("timestamp_ntz"))).first()[0] == want


def test_daylight_saving(spark):
    utc = [("2024-03-08 14:30:00", 9), ("2024-03-11 13:30:00", 9), ("2024-11-01 13:30:00", 9), ("2024-11-04 14:30:00", 9)]
    for text, hour in utc:
        r = spark.range(1).select(C.to_market_tz(F.lit(text).cast("timestamp_ntz")).alias("t")).first()
        assert (r.t.hour, r.t.minute) == (hour, 30)


def test_safe_float(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(C.safe_float(F.col("x"))).collect()] == [1.5, None, None, None]


def test_atr_needs_fourteen_rows(spark):
    got = [r.atr for r in levels.atr(daily(spark, [10.0] * 15)).orderBy("day").collect()]
    assert got[:13] == [None] * 13 and got[13] == pytest.approx(2.0)


def test_pivots_leave_out_edges_and_equal_highs(spark):
    df = daily(spark, [1, 2, 9, 2, 1, 5, 5, 1, 2, 8.0])
    days = df.where(F.col("day") == dt.date(2024, 1, 10)).select("ticker", "day")
    got = {(r.side, r.price) for r in levels.swing_pivots(df, days).collect()}
    assert ("high", 10.0) in got and ("high", 6.0) not in got and ("high", 9.0) not in got


def test_stronger_duplicate_keeps_first_place(spark):
    df = spark.createDataFrame([("a", DAY, 1, "x", "support", "s", None, 5.0, 2), ("a", DAY, 2, "y", "support", "t", None, 6.0, 3), ("a", DAY, 3, "z", "support", "s", None, 5.001, 3)],
                               "ticker string, day date, ord int, id string, kind string, source string, session string, price double, strength int")
    context = spark.createDataFrame([("a", DAY, None, None)], "ticker string, day date, last double, atr double")
    got = levels.levels_topk(levels.levels_dedupe(df), context).orderBy("rank").collect()
    assert [(r.id, r.pos, r["rank"]) for r in got] == [("z", 1, 1), ("y", 2, 2)]


def test_state_in_two_halves_is_one_pass(spark):
    start = dt.datetime(2024, 1, 10, 9, 0)
    rows = [("a", DAY, start + dt.timedelta(minutes=5 * i), 1.0 + i % 7, 3.0 + i % 5, 0.5 + i % 3, 2.0 + i % 4, float(i % 6), "PRE" if i < 6 else "RTH") for i in range(40)]
    bars = spark.createDataFrame(rows, BAR)
    first = session.session_agg(bars.where(F.col("ts") < start + dt.timedelta(minutes=100)))
    order = lambda df: [tuple(r) for r in df.select("session", "high", "low", "close", "bar_count", "sum_pv", "vwap").orderBy("session").collect()]
    assert order(session.merge_state(first, bars)) == order(session.session_agg(bars))


def test_opening_range_is_open_until_its_last_bar(spark):
    rows = [("a", DAY, dt.datetime(2024, 1, 10, 9, 30) + dt.timedelta(minutes=5 * i), 1.0, 2.0 + i, 1.0 - i, 1.0, 1.0, "RTH") for i in range(5)]
    assert not session.opening_range(spark.createDataFrame(rows, BAR)).first().complete
    rows.append(("a", DAY, dt.datetime(2024, 1, 10, 9, 55), 1.0, 2.0, 1.0, 1.0, 1.0, "RTH"))
    r = session.opening_range(spark.createDataFrame(rows, BAR)).first()
    assert r.complete and (r.high, r.low) == (6.0, -3.0)


def test_zero_counts_as_no_price(spark):
    df = spark.createDataFrame([(0.0, 5.0), (3.0, 5.0), (None, 0.0)], "r double, p double")
    assert [x[0] for x in df.select(session.last_price(F.col("r"), F.col("p"))).collect()] == [5.0, 3.0, None]


def test_regime_rules_pass_over_nulls(spark):
    rows = [("a", dt.date(2024, 1, i + 1), c, er, s, ra) for i, (c, er, s, ra) in enumerate([(1.0, None, None, None), (1.0, 0.6, 0.01, None), (1.0, 0.6, -0.01, 1.0), (1.0, 0.3, None, 1.0), (0.0, 0.6, 0.01, 1.4)])]
    df = spark.createDataFrame(rows, "ticker string, day date, close double, er double, slope_close double, range_atr double")
    got = regimes.label_regimes(df).orderBy("day").collect()
    assert [r.regime for r in got] == ["transition", "trend_up", "trend_down", "range", "high_vol"]
    assert got[0].changed and got[4].slope_n is None


def test_null_er_counts_as_weak_trend(spark):
    cols = dict(bars_remaining=20, sigma_rem_atr=0.3, overlap=0.7, er=None, breakout_up=0.9, breakout_down=0.1, stall=0.2)
    kinds = "bars_remaining long, sigma_rem_atr double, overlap double, er double, breakout_up double, breakout_down double, stall double"
    r = insights.rationale(insights.guidance(spark.createDataFrame([tuple(cols.values())], kinds))).first()
    assert r.trade_bias == "range/mean_reversion" and r.prefer_spreads and not r.avoid_trading
    assert r.rationale == ["R_CHOPPY_TAPE", "R_OVERLAP_ER|0.700|NA"]


def test_inverse_normal(spark):
    from statistics import NormalDist

    for p in (0.001, 0.02, 0.3, 0.5, 0.725, 0.84, 0.975, 0.999):
        assert spark.range(1).select(insights.norm_ppf(F.lit(p))).first()[0] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-7)
    assert spark.range(1).select(insights.norm_ppf(F.lit(1.0))).first()[0] is None


def test_next_session_over_weekends_and_holidays(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 12),), (dt.date(2024, 1, 13),), (dt.date(2024, 1, 16),)], "day date")
    assert [r.next_day.day for r in eod.next_session(days).orderBy("day").collect()] == [15, 15, 17]
    calendar = spark.createDataFrame([(dt.date(2024, 1, 16),), (dt.date(2024, 1, 17),)], "day date")
    assert [r.next_day.day for r in eod.next_session(days, calendar).orderBy("day").collect()] == [16, 16, 17]


def test_notes_in_both_languages(spark):
    items = ["N_REGIME|high_vol", "N_GAP|-1.20", "other"]
    got = [r.text for r in localize.localize_notes(spark.createDataFrame([(n,) for n in items], "item string")).collect()]
    assert got[0].startswith("Regime=high_vol: consider") and " / 市场状态=高波动（方向不明）：" in got[0] and "gap_atr=-1.20）" in got[1] and got[2] == "other"
    values = spark.createDataFrame([("regime", " Range "), ("kind", "?")], "what string, value string")
    assert {r.text for r in localize.localize_values(values, localize.value_labels(spark), "zh").collect()} == {"区间震荡", "?"}


def test_validation_fails_loudly(spark):
    bars = spark.createDataFrame([("a", DAY, dt.datetime(2024, 1, 10, 10), 1.0, 0.5, 1.0, 1.0, 1.0, "RTH")], BAR)
    with pytest.raises(Exception, match="bad bar"):
        clean.assert_valid(bars).collect()
    with pytest.raises(ValueError, match="no rows"):
        clean.assert_valid(bars.limit(0))
    with pytest.raises(ValueError, match="columns"):
        clean.assert_valid(bars.drop("high"))


def test_wide_provider_columns(spark):
    raw = spark.createDataFrame([("2024-01-10", "1", "2", "0.5", "1.5", "7", "3", "4", "2", "x", "8")], "Date string, `Open|A` string, `High|A` string, `Low|A` string, `Close|A` string, `Volume|A` string, `Open|B` string, `High|B` string, `Low|B` string, `Close|B` string, `Volume|B` string")
    got = src.normalize_bars(src.unpivot_provider(raw), "daily", keep=("symbol",)).collect()
    assert [(r.symbol, r.close) for r in got] == [("A", 1.5)]


def test_model_learns_and_failures_stay_apart(spark):
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(i), float(i % 2) + 0.01 * (i % 7), None if i % 11 == 0 else 1.0, "up" if i % 2 else "down") for t in ("a", "b") for i in range(80 if t == "a" else 5)]
    df = spark.createDataFrame(rows, "ticker string, day date, x double, y double, regime string")
    models = ml.fit_all(df, ["x", "y"], max_iter=20)
    found = {r.ticker: r for r in models.collect()}
    assert found["a"].error is None and found["a"].classes == ["down", "up"] and "5 training rows" in found["b"].error
    r = ml.metrics(ml.predict_all(models, df, ["x", "y"])).collect()
    assert len(r) == 1 and r[0].ticker == "a" and r[0].accuracy == 1.0 and r[0].balanced_accuracy == 1.0


@pytest.mark.parametrize("weighted", [False, True])
def test_grouped_fit_agrees_with_the_library(spark, weighted):
    import numpy as np

    rng, rows = np.random.default_rng(4), []
    for t in ("a", "b"):
        for i in range(240):
            x = rng.normal(size=3)
            score = [x[0] + 0.5 * rng.normal(), -x[0] + x[1], 0.4 + 0.3 * rng.normal()]
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(i), *(None if rng.random() < 0.02 else float(v) for v in x), ["down", "range", "up"][int(np.argmax(score))]))
    df = spark.createDataFrame(rows, "ticker string, day date, x double, y double, z double, regime string").cache()
    ours = {(r.ticker, r.day): r.prediction for r in ml.predict_all(ml.fit_all(df, "xyz", weighted=weighted), df, "xyz").collect()}
    for t in ("a", "b"):
        own = df.where(F.col("ticker") == t)
        model = ml.fit_regime(ml.class_weights(own) if weighted else own, list("xyz"), weighted=weighted)
        theirs = {(r.ticker, r.day): r.prediction for r in ml.predict(model, own).collect()}
        assert sum(ours[k] == v for k, v in theirs.items()) >= 0.99 * len(theirs)


def test_multinomial_fit_has_no_slope_left(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 4)), rng.integers(0, 3, 200)
    beta, eps = ml.multinomial(x, y, np.ones(200), 0.01), 1e-5

    def loss(b):
        p = ml.softmax(np.column_stack([x, np.ones(200)]) @ b.T)[np.arange(200), y]
        return -np.log(p).mean() + 0.005 * (b[:, :-1] ** 2).sum()

    for at in np.ndindex(*beta.shape):
        move = np.zeros(beta.shape)
        move[at] = eps
        assert abs(loss(beta + move) - loss(beta - move)) / (2 * eps) < 1e-6


@pytest.mark.parametrize("price", [0.0, -2.0, None])
def test_a_price_of_zero_or_below_gives_no_return(spark, price):
    closes = [10.0 + i % 3 for i in range(70)]
    days = daily(spark, closes).withColumn("close", F.when(F.col("day") == dt.date(2024, 2, 1), F.lit(price).cast("double")).otherwise(F.col("close")))
    got = {r.day: r for r in features.daily_features(days).collect()}
    assert len(got) == 70 and got[dt.date(2024, 2, 5)].rv is None and got[dt.date(2024, 3, 1)].rv is not None
    at = dt.datetime(2024, 1, 10, 9, 30)
    rows = [("a", DAY, at + dt.timedelta(minutes=5 * i), 1.0, 12.0, 0.0, price if i == 20 else closes[i], 1.0, "RTH") for i in range(60)]
    context = spark.createDataFrame([("a", DAY, 2.0, 10.0, 12.0, 8.0)], "ticker string, day date, atr double, rth_vwap double, rth_high double, rth_low double")
    found = [r.rv for r in features.intraday_features(spark.createDataFrame(rows, BAR), context).orderBy("ts").collect()]
    assert found[19] is not None and found[25] is None and found[40] is not None


def test_empty_inputs(spark):
    none = spark.createDataFrame([], BAR)
    assert session.session_agg(none).count() == 0 and features.daily_features(none.drop("ts", "session")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda key: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(SimpleNamespace(sparkContext=context))


def test_a_finished_table_leaves_nothing_else(spark):
    import os

    kept, since = shared.stored(spark.range(3), "kept"), len(shared.paths())
    between = shared.stored(kept.where("id > 0"), "between")
    out = shared.finished(between.selectExpr("id * 2 AS twice"), "out", since)
    assert sorted(r.twice for r in out.collect()) == [2, 4] and kept.count() == 3 and len(shared.paths()) == since + 1
    folder = shared.shared_dir(spark).removeprefix("file://") + "/barlight"
    assert not [f for f in os.listdir(folder) if f.startswith("between-")]


def test_a_query_leaves_its_result_alone(spark):
    import os

    from barlight.plans import registry

    folder = shared.shared_dir(spark).removeprefix("file://") + "/barlight"
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    out = registry.queries()["session_state_wide"](spark, "/root/testdata/sf0.001")
    assert [f for f in there() - before if not f.startswith("session_state_wide-")] == [] and out.count() > 0
    registry.register("failing")(lambda t: (t.kept_bars, 1 / 0))
    before = there()
    try:
        with pytest.raises(ZeroDivisionError):
            registry.queries()["failing"](spark, "/root/testdata/sf0.001")
    finally:
        del registry.QUERIES["failing"]
    assert there() == before
