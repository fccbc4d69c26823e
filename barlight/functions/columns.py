"""Column expressions shared by the operators; all are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_TZ = "America/New_York"
#: Session bounds in seconds of the local day: 04:00, 09:30, 16:00, 20:00.
PRE_OPEN, RTH_OPEN, RTH_CLOSE, AFT_CLOSE = 14400, 34200, 57600, 72000
SESSIONS = ("PRE", "RTH", "AFT")


def safe_float(x: Column) -> Column:
    """A double, or null where x is null, NaN or no number."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v), v)


def zero_as_missing(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def to_market_tz(ts: Column, tz: str = MARKET_TZ) -> Column:
    """Local wall time of a naive UTC timestamp; an unknown zone fails when the query runs."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("int")


def label_session(ts: Column) -> Column:
    """PRE, RTH, AFT or CLOSED of a local timestamp; lower bounds belong to the session."""
    s = seconds_of_day(ts)
    return (F.when((s >= PRE_OPEN) & (s < RTH_OPEN), "PRE").when((s >= RTH_OPEN) & (s < RTH_CLOSE), "RTH")
            .when((s >= RTH_CLOSE) & (s < AFT_CLOSE), "AFT").otherwise("CLOSED"))


def trading_day(ts: Column) -> Column:
    return F.to_date(ts)


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / 3.0


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def zone_half_width(price: Column, atr: Column, atr_mult: float = 0.20, min_bp: float = 8.0) -> Column:
    """The wider of a share of the price in basis points and a share of the ATR, if that is above zero."""
    return F.greatest(price * (min_bp / 10000.0), F.when(atr > 0, atr * atr_mult))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.when(b != 0, a / b)
