"""What must hold as tables grow: plans without sorts of raw ticks, upserts of touched days only, nightly runs, exact
cutoffs and sinks of streams, isolated tickers, versioned models."""

import datetime as dt
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlight.functions.columns import label_session
from barlight.operators import clean, features, levels, ml, session
from barlight.plans import nightly, pipelines, registry
from barlight.sources import bars as src
from barlight.sources.models import CommitConflict, ModelTable
from barlight.streaming import session as streams
from barlight.streaming import sinks

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DAY = dt.date(2024, 1, 10)
TICKS = "ticker string, ts timestamp_ntz, price double, volume double, seq long"


def random_ticks(n=4000):
    rng = random.Random(3)
    at = dt.datetime(2024, 1, 10, 9)
    rows = [(rng.choice("abc"), at + dt.timedelta(seconds=rng.randrange(40) * 60), float(rng.randrange(1000)), 1.0, s) for s in rng.sample(range(-(10**6), 10**6), n)]
    return rows + [("a", at, 5.0, 1.0, 2**63 - 1), ("a", at, 6.0, 1.0, -(2**63)), ("b", dt.datetime(1960, 1, 1), 7.0, None, 3), ("b", None, 8.0, 1.0, 4), ("c", at, 9.0, 1.0, None)]


@pytest.mark.parametrize("key", ["bars_5m", "bars_daily", "bars_daily_long", "floor_5m"])
def test_no_tick_is_sorted(spark, key):
    plan = registry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and not [x for x in ("Sort", "Window") if x in plan]


def test_tumbling_bars_keep_no_order(spark, tmp_path):
    spark.createDataFrame(random_ticks(50), TICKS).write.parquet(f"{tmp_path}/in")
    stream = streams.stream_bars(spark.readStream.schema(TICKS).parquet(f"{tmp_path}/in"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "min_by(price" in plan and "struct(ts" not in plan and "decimal(38,0)" in plan


def test_bars_of_a_packed_key(spark):
    ticks = spark.createDataFrame(random_ticks(), TICKS).repartition(5)
    for width in ("5 minutes", "1 day"):
        packed, struct = clean.build_bars(ticks, width), clean.build_bars(ticks, width, F.struct("ts", "seq"))
        assert sorted(map(repr, packed.collect())) == sorted(map(repr, struct.collect()))


@pytest.mark.parametrize("text", [False, True])
def test_grid_takes_the_last_row(spark, text):
    ticks = spark.createDataFrame(random_ticks(), TICKS).repartition(5)
    ticks = ticks.withColumn("note", F.concat(F.lit("n"), "seq")) if text else ticks
    w = Window.partitionBy("ticker", "grid").orderBy(F.desc("ts"), F.desc("seq"))
    want = ticks.withColumn("grid", F.window("ts", "5 minutes")["start"].cast("timestamp_ntz")).withColumn("n", F.row_number().over(w)).where("n = 1")
    got = clean.floor_grid(ticks).withColumnRenamed("ts", "grid").select("ticker", "grid", "price", "volume", "seq", *["note"] * text)
    known = "grid IS NOT NULL"
    assert sorted(map(repr, got.where(known).collect())) == sorted(map(repr, want.where(known).select(*got.columns).collect()))
    assert got.where("grid IS NULL").count() == 0  # a row without a time has no place on the grid


@pytest.mark.parametrize("block", [7, 100, 10**6])
def test_validation_by_blocks(spark, block):
    rng, rows = random.Random(7), []
    for ticker, swaps in (("hot", 3), ("sorted", 0), ("few", 1)):
        n = 500 if ticker != "few" else 3
        at = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2) for i in range(n)]
        for _ in range(swaps):
            i, j = rng.randrange(n), rng.randrange(n)
            at[i], at[j] = at[j], at[i]
        rows += [(ticker, None if i % 41 == 40 else t, 1.0, 2.0 if i % 9 else 0.5, 0.7, 1.0, 1.0, i * 3) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq long").repartition(4)
    back = F.lag("ts").over(Window.partitionBy("ticker").orderBy("seq"))
    want = df.withColumn("ok", F.coalesce(F.col("ts") >= back, F.lit(True))).groupBy("ticker").agg(
        F.count("*").alias("rows"), F.min("ok").alias("monotonic_ts"), (F.count("ts") - F.countDistinct("ts")).alias("duplicate_ts"), F.count_if(clean.bad_ohlc()).alias("bad_ohlc_rows"))
    assert sorted(clean.validation_report(df, block=block).collect()) == sorted(want.collect())
    assert clean.validation_report(df.limit(0)).count() == 0


def test_a_hot_day_is_many_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.concat(F.lit("t"), (F.col("id") % 50).cast("string")).alias("ticker"), F.lit(DAY).alias("day"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.rand(1).alias("close"))
    src.write_bars(rows, f"{tmp_path}/t", 3000)
    files = [f"{tmp_path}/t/day={DAY}/{f}" for f in os.listdir(f"{tmp_path}/t/day={DAY}") if f.endswith(".parquet")]
    holding = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_rows <= 3000
        s = meta.row_group(0).column(0).statistics
        holding += s.min <= "t17" <= s.max
    assert len(files) >= 14 and holding <= 3  # of 50 tickers in ranges, one is in a file or two
    assert spark.read.parquet(f"{tmp_path}/t").where("ticker = 't17'").count() == 800


RAW = "symbol string, seq long, Datetime string, Open string, High string, Low string, Close string, Volume string"


def provider(days, seq, price, symbol="$A"):
    return [(symbol, seq + 10 * d + k, f"2024-01-{d:02d} 15:{5 * k:02d}:01", *[str(price + k)] * 4, "1") for d in days for k in range(5)]


def test_ingest_touches_the_fetched_days(spark, tmp_path):
    universe, path = spark.createDataFrame([("a", "A", "stock")], "ticker string, provider_symbol string, kind string"), f"{tmp_path}/bars"
    schema = pipelines.normalized(spark.createDataFrame([], RAW), universe)[0].schema
    frame = lambda rows: spark.createDataFrame(rows, RAW)
    files = lambda: {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("day")}
    content = lambda: sorted(map(repr, src.scan_bars(spark, path, schema).select("ticker", "day", "ts", "seq", "close").collect()))
    assert pipelines.ingest_into(frame(provider(range(2, 12), 0, 10.0)), path, universe, schema)[0] == [dt.date(2024, 1, d) for d in range(2, 12)]
    before, was = files(), content()
    new = provider([10, 11, 12], 1000, 50.0)[2:]
    days, bad = pipelines.ingest_into(frame(new), path, universe, schema)
    assert days == [dt.date(2024, 1, d) for d in (10, 11, 12)] and bad.count() == 0
    after, now = files(), content()
    assert all(after[d] == before[d] for d in before if d[-2:] not in ("10", "11")) and all(after[f"day=2024-01-{d}"] != before.get(f"day=2024-01-{d}") for d in (10, 11, 12))
    assert len(now) == 55 and sum(x in was for x in now) == 42  # two bars of the 10th stay
    pipelines.ingest_into(frame(new), path, universe, schema)
    assert content() == now and files().keys() == after.keys()
    assert pipelines.ingest_into(frame([]), path, universe, schema)[0] == []
    read = src.scan_bars(spark, path, schema).where(F.col("day").isin(days))
    assert {f.split("day=")[1][:10] for f in scanned(read)} == set(map(str, days))


def scanned(df):
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


BARS = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def arrivals():
    """Files of bars: out of order within and between them, ticker b late by more than an hour, one file repeated."""
    at = lambda h, m: dt.datetime(2024, 1, 10, h, m)
    bar = lambda t, ts, p: (t, ts, p, p + 1, p - 1, p, 2.0)
    return [
        [bar("a", at(9, 35), 10.0), bar("a", at(9, 30), 9.0), bar("a", at(9, 20), 8.0), bar("b", at(4, 0), 5.0)],
        [bar("a", at(15, 0), 12.0), bar("a", at(9, 32), 99.0), bar("a", at(16, 30), 13.0)],
        [bar("b", at(9, 30), 6.0), bar("b", at(10, 0), 7.0), bar("a", at(16, 0), 99.0)],
        [bar("b", at(9, 30), 99.0), bar("b", at(10, 5), 8.0), bar("b", at(3, 0), 1.0), ("a", at(16, 35), 13.0, 14.0, 12.0, None, None)],
        [bar("b", at(9, 30), 6.0), bar("b", at(10, 0), 7.0), bar("a", at(16, 0), 99.0)],
        [bar("a", dt.datetime(2024, 1, 11, 9, 30), 20.0), bar("b", at(15, 55), 9.0)],
    ]


def put(spark, path, i, rows):
    spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(path)
    newest = max((f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
    os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))


def run_stream(spark, path, out, offsets, write=None):
    rows = streams.stream_session_state(spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(path))
    q = rows.writeStream.outputMode("update").option("checkpointLocation", offsets).foreachBatch(write or sinks.batch_sink(out)).trigger(availableNow=True).start()
    q.awaitTermination()


STATE = ("ticker", "day", "session", "high", "low", "close", "bar_count", "vwap")


def test_stream_ignores_what_its_ticker_has_passed(spark, tmp_path):
    path, out, offsets = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/offsets"
    want = None
    for i, rows in enumerate(arrivals()):
        put(spark, path, i, rows)
        bars = spark.createDataFrame(rows, BARS).withColumns({"session": label_session(F.col("ts")), "day": F.to_date("ts")}).where("session <> 'CLOSED'")
        want = session.session_agg(bars) if want is None else session.merge_state(want, bars)
        want = spark.createDataFrame(want.collect(), want.schema)
        if i in (2, 5):  # the stream stops and starts again between
            run_stream(spark, path, out, offsets)
    got = sinks.newest_rows(sinks.read_sink(spark, out), "ticker", "day", "session").select(*STATE)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*STATE).collect())) and got.count() == 6


def test_a_retried_batch_is_written_once(spark, tmp_path):
    path, out, offsets = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/offsets"
    for i, rows in enumerate(arrivals()):
        put(spark, path, i, rows)
    failed, good = [], sinks.batch_sink(out)

    def once(batch, number):
        good(batch, number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("between write and commit")

    with pytest.raises(Exception, match="between write and commit"):
        run_stream(spark, path, out, offsets, once)
    run_stream(spark, path, out, offsets, once)
    rows = sinks.read_sink(spark, out)
    assert failed == [2] and rows.count() == rows.dropDuplicates(["_batch", "ticker", "day", "session"]).count()
    run_stream(spark, path, f"{tmp_path}/other", f"{tmp_path}/fresh")
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, sinks.read_sink(spark, f"{tmp_path}/other").collect()))


def test_one_bad_ticker_holds_up_no_other(spark):
    rows = [(t, dt.date(2024, 1, d), dt.datetime(2024, 1, d, 9, 30) + dt.timedelta(minutes=5 * i), 10.0, 11.0, 9.0, 10.0 + i % 2, 1.0, "RTH")
            for t in ("good", "wild", "crossed", "timeless", "silent") for d in range(1, 25) for i in range(14)]
    schema = "ticker string, day date, ts timestamp_ntz, open double, high double, low double, close double, volume double, session string"
    bars = spark.createDataFrame(rows, schema).withColumns({
        "high": F.when((F.col("ticker") == "wild") & (F.minute("ts") == 35), float("inf")).when((F.col("ticker") == "crossed") & (F.minute("ts") == 35), 1.0).otherwise(F.col("high")),
        "ts": F.when((F.col("ticker") != "timeless") | (F.minute("ts") != 35), F.col("ts")), "volume": F.when((F.col("ticker") != "silent") | (F.minute("ts") != 35), F.col("volume"))})
    universe = spark.createDataFrame([(t,) for t in ("good", "wild", "crossed", "timeless", "silent", "absent")], "ticker string")
    out, status = pipelines.isolated_pipeline(bars, universe)
    assert {r.ticker: (r.status, r.reason) for r in status.collect()} == {
        "good": ("ok", None), "wild": ("error", "price out of range"), "crossed": ("error", "bad prices"), "timeless": ("error", "no time"), "silent": ("error", "no volume"), "absent": ("error", "no bars")}
    assert {r.ticker for r in out.select("ticker").collect()} == {"good"}
    alone, _ = pipelines.isolated_pipeline(bars.where("ticker = 'good'"), universe)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, alone.collect()))


def test_models_are_committed_by_compare_and_swap(spark, tmp_path):
    rng, rows = random.Random(2), []
    for t in ("a", "b"):
        for i in range(60):
            x = rng.gauss(0, 1)
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(i), x, "up" if x + 0.2 * rng.gauss(0, 1) > 0 else "down"))
    df = spark.createDataFrame(rows, "ticker string, day date, x double, regime string")
    table = ModelTable(spark, f"file://{tmp_path}/models")
    assert table.version() == 0 and table.load() is None
    fitted = ml.fit_all(df, ["x"]).withColumn("model", F.col("ticker"))
    at = lambda rows, day: rows.withColumn("asof_day", F.lit(day).cast("date"))
    assert table.commit(at(fitted, "2020-03-01"), 0) == 1
    other = ModelTable(spark, f"file://{tmp_path}/models")
    seen = other.version()
    assert table.commit(at(fitted.where("ticker = 'a'"), "2020-04-01"), table.version()) == 2
    with pytest.raises(CommitConflict):
        other.commit(at(fitted, "2020-05-01"), seen)
    assert len(os.listdir(f"{tmp_path}/models/rows")) == 2 and other.commit(at(fitted.where("ticker = 'b'"), "2020-02-01"), other.version()) == 3
    assert {r.model: (r.commit_no, str(r.asof_day)) for r in table.load().collect()} == {"a": (2, "2020-04-01"), "b": (1, "2020-03-01")}
    assert {r.model: r.commit_no for r in table.load(F.lit("2020-03-15").cast("date")).collect()} == {"a": 1, "b": 1}
    assert {r.model: r.commit_no for r in table.load(F.lit("2020-02-15").cast("date")).collect()} == {"b": 3}
    assert {r.model: r.commit_no for r in table.load(version=1).collect()} == {"a": 1, "b": 1}
    open(f"{tmp_path}/models/log/{4:012d}", "w").close()  # an entry that is being made
    loaded = table.load().drop("model", "asof_day", "commit_no")
    want = {(r.ticker, r.day): r.prediction for r in ml.predict_all(fitted.drop("model"), df, ["x"]).collect()}
    assert {(r.ticker, r.day): r.prediction for r in ml.predict_all(loaded, df, ["x"]).collect()} == want


def test_nightly_runs_equal_the_whole(spark, tmp_path):
    rng, rows = random.Random(5), []
    for t, gap in (("a", 0), ("b", 7), ("c", 2)):
        for i in range(60):
            if gap and i % gap == 1:
                continue
            p = 100 + rng.gauss(0, 3)
            rows.append((t, dt.date(2024, 1, 1) + dt.timedelta(i), p, p + rng.random(), p - rng.random(), p + rng.gauss(0, 0.2), float(rng.randrange(1000))))
    daily = spark.createDataFrame(rows, "ticker string, day date, open double, high double, low double, close double, volume double").cache()
    table, tail, out = f"{tmp_path}/daily", f"{tmp_path}/tail", f"{tmp_path}/out"
    src.write_bars(daily, table)
    start = dt.date(2024, 2, 20)
    nightly.leave_tail(daily.where(F.col("day") < F.lit(start)), tail, str(start - dt.timedelta(1)), nightly.PIVOT_ROWS)
    days = [start + dt.timedelta(i) for i in range(10)]
    for d in [*days, days[-1]]:  # the last one twice
        read = nightly.nightly(spark, table, out, tail, str(d), rows=nightly.PIVOT_ROWS)
        assert {f.split("day=")[1][:10] for f in scanned(read)} <= {str(d)}
    got = src.scan_bars(spark, out, nightly.features_schema()).orderBy("ticker", "day").toPandas()
    want = features.daily_features(daily, min_rows=1).where(F.col("day") >= F.lit(start)).orderBy("ticker", "day").toPandas()
    assert len(got) == len(want) > 20 and list(got.ticker) == list(want.ticker) and list(got.day) == list(want.day)
    for c in ("atr", "rv", "er", "slope_close", "pos_hhll", "vol_z", "range_atr", "gap_atr"):
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-9, nan_ok=True) and got[c].notna().sum() > 15
    day = days[-1]
    nightly.nightly(spark, table, f"{tmp_path}/pivots", tail, str(day), nightly.pivot_run, nightly.PIVOT_ROWS)
    seen = sorted(map(repr, spark.read.parquet(f"{tmp_path}/pivots").select("ticker", "side", "price", "pivot_day").collect()))
    whole = levels.swing_pivots(daily, daily.where(F.col("day") == F.lit(day)).select("ticker", "day"))
    assert seen == sorted(map(repr, whole.select("ticker", "side", "price", "pivot_day").collect())) and seen
    for rows in (5, 200):
        nightly.leave_tail(daily, f"{tmp_path}/tail{rows}", "2024-03-01", rows)
        assert spark.read.parquet(f"{tmp_path}/tail{rows}").groupBy("ticker").count().agg(F.max("count")).first()[0] == min(rows, 60)


def whole_history(bars, n=12):
    """rv, er and overlap by one window over a ticker's whole history."""
    order = Window.partitionBy("ticker").orderBy("ts")
    w, back = order.rowsBetween(-(n - 1), 0), F.lag("close").over(order)
    high, low = F.lag("high").over(order), F.lag("low").over(order)
    both = F.greatest(F.least("high", high) - F.greatest("low", low), F.lit(0.0)) / (F.greatest("high", high) - F.least("low", low))
    out = bars.withColumns({"r": F.ln(F.col("close") / back), "s": F.abs(F.col("close") - back), "o": F.when(high.isNotNull(), both)})
    full = lambda f, c: F.when(F.count(c).over(w) == n, f(c).over(w))
    return out.select("ticker", "ts", full(F.stddev_samp, "r").alias("rv"), full(F.avg, "o").alias("overlap"),
                      (F.abs(F.col("close") - F.lag("close", n).over(order)) / full(F.sum, "s")).alias("er"))


@pytest.mark.parametrize("block", [1, 7, 40, 10_000])
def test_features_by_blocks_of_days(spark, tmp_path, block):
    """Days of 1 to 30 bars, so that frames reach over several days and blocks."""
    rng, rows = random.Random(5), []
    for ticker in ("hot", "thin"):
        for d in range(60):
            for k in sorted(rng.sample(range(70), rng.randint(1, 30 if ticker == "hot" else 3))):
                low, close = rng.uniform(90, 100), rng.uniform(100, 110)
                rows.append((ticker, dt.date(2024, 1, 1) + dt.timedelta(d), dt.datetime(2024, 1, 1, 10) + dt.timedelta(days=d, minutes=5 * k), close + 1, low, close))
    spark.createDataFrame(rows, "ticker string, day date, ts timestamp_ntz, high double, low double, close double").write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    context = bars.select("ticker", "day", F.lit(1.0).alias("atr"), *[F.lit(100.0).alias(c) for c in ("rth_vwap", "rth_high", "rth_low")]).distinct()
    values = lambda df: {(r.ticker, r.ts): (r.rv, r.er, r.overlap) for r in df.collect()}
    got, want = values(features.intraday_features(bars, context, block=block)), values(whole_history(bars))
    assert len(got) == len(rows) and got.keys() == want.keys()
    for key, row in want.items():
        assert [x is None for x in got[key]] == [x is None for x in row], key
        assert [x or 0.0 for x in got[key]] == pytest.approx([x or 0.0 for x in row], rel=1e-9, abs=1e-12), key
    assert sum(v[0] is not None for v in got.values()) == len(rows) - 24


def test_a_ticker_is_many_blocks(spark):
    days = [(dt.date(2020, 1, 1) + dt.timedelta(d), k) for d in range(400) for k in range(5)]
    bars = spark.createDataFrame([("a", d) for d, _ in days], "ticker string, day date")
    got = features.day_blocks(bars, 12, 100).collect()
    assert {r.block for r in got} == set(range(20))
    assert all(r.blocks[0] == r.block and len(r.blocks) <= 2 for r in got)
    assert sum(len(r.blocks) == 2 for r in got) == 19 * 3  # three days of five bars cover the twelve before a block
