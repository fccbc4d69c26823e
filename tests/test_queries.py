"""Every query that has an oracle against DuckDB on the smallest tables."""

import datetime as dt
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from barlight.operators import ml
from barlight.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = registry.oracles()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    """A value that equal values of both engines share: missing ones None, numbers as floats (pandas makes them so where
    some are missing), dates and midnights as text."""
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, numbers.Real) and not isinstance(x, bool | np.bool_):
        return float(x)
    if isinstance(x, pd.Timestamp):
        return str(x)[:10] if x == x.normalize() else x.floor("us")
    return str(x)[:10] if isinstance(x, dt.date) else x


def rows(df):
    df = df[sorted(df.columns)]
    found = zip(*(df[c].astype(object).tolist() for c in df.columns), strict=True)
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple(map(repr, r)))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, db, key):
    ours = registry.queries()[key](spark, SF).toPandas()
    theirs = db.sql(ORACLES[key]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_a_schema_without_nesting(spark):
    for key in ("levels", "insights", "eod_plan"):
        assert not [f for f in registry.queries()[key](spark, SF).schema if f.dataType.simpleString().startswith(("array", "struct", "map"))]


def test_daily_features_shuffle_once(spark):
    from barlight.operators import features

    daily = spark.createDataFrame([("a", "2024-01-01", 1.0, 2.0, 0.5, 1.5, 3.0)], "ticker string, day string, open double, high double, low double, close double, volume double")
    plan = features.daily_features(daily)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("key", ["levels", "insights", "level_pressure", "eod_plan"])
def test_ticks_are_read_once(spark, key, monkeypatch):
    read = []
    own = registry.Tables.raw
    monkeypatch.setattr(registry.Tables, "raw", lambda self, name: (read.append(name), own(self, name))[1])
    out = registry.queries()[key](spark, SF)
    assert read.count("events") == 1 and not [f for f in out.inputFiles() if "events" in f]


def plain_predictions(rows, columns, by_ticker, weighted):
    """Holdout predictions of multinomial logistic regression in numpy, by ticker or over all."""
    out = {}
    for _, f in rows.groupby("ticker") if by_ticker else [("", rows)]:
        train, rest = f[f.split == "train"], f[f.split == "holdout"]
        x = train[columns].to_numpy(float)
        medians = np.nanmedian(x, axis=0)
        fill = lambda v, m=medians: np.where(np.isnan(v), m, v)
        mean, sd = fill(x).mean(axis=0), fill(x).std(axis=0, ddof=1)
        classes, y = np.unique(train.regime.to_numpy(str), return_inverse=True)
        weight = np.ones(len(y))
        if weighted:
            own = train.groupby(["ticker", "regime"]).regime.transform("size").to_numpy(float)
            weight = train.groupby("ticker").regime.transform("size").to_numpy() / (train.groupby("ticker").regime.transform("nunique").to_numpy() * own)
        beta = ml.multinomial((fill(x) - mean) / sd, y, weight, 1.0 / len(y))
        z = (fill(rest[columns].to_numpy(float)) - mean) / sd
        said = classes[(np.column_stack([z, np.ones(len(z))]) @ beta.T).argmax(axis=1)]
        out |= dict(zip(zip(rest.ticker, rest.day, strict=True), zip(rest.regime, said, strict=True), strict=True))
    return out


def plain_metrics(predictions):
    out = {}
    for ticker in {t for t, _ in predictions}:
        own = [v for (t, _), v in predictions.items() if t == ticker]
        recall = [np.mean([a == b for a, b in own if a == c]) for c in {a for a, _ in own}]
        out[ticker] = (np.mean([a == b for a, b in own]), np.mean(recall))
    return out


def test_models_against_numpy(spark):
    tables, columns = registry.Tables(spark, SF), list(registry._COLS)
    rows = tables.training.toPandas()
    want = plain_predictions(rows, columns, False, False)
    got = {(r.ticker, r.day): r.prediction for r in registry.queries()["predict_regime"](spark, SF).collect()}
    assert len(got) == len(want) > 100 and sum(got[k] == v[1] for k, v in want.items()) >= 0.99 * len(want)
    for key, by_ticker in (("regime_model", False), ("regime_models_all", True)):
        want = plain_metrics(plain_predictions(rows, columns, by_ticker, True))
        got = {r.ticker: (r.accuracy, r.balanced_accuracy) for r in registry.queries()[key](spark, SF).collect()}
        assert got.keys() == want.keys()
        assert all(got[t] == pytest.approx(want[t], abs=0.02) for t in want), (key, got, want)
