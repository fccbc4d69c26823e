"""DuckDB forms of the operators, as common table expressions over the driver's tables."""

from __future__ import annotations

import re

from barlight.operators.insights import PPF_A, PPF_B

_ROLL = """arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume"""

#: Name to SQL; each may use those before it.
STEPS = {
    "ticks": (
        "SELECT event_type AS ticker, timezone('America/New_York', timezone('UTC', ts)) AS ts, value AS price, "
        "1.0::DOUBLE AS volume, event_id AS seq FROM events"),
    "b0": f"SELECT ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS bts, {_ROLL} FROM ticks GROUP BY 1, 2",
    "sess": (
        "SELECT ticker, CAST(bts AS DATE) AS day, bts AS ts, open, high, low, close, volume, "
        "(hour(bts) * 3600 + minute(bts) * 60 + second(bts)) AS s FROM b0"),
    "b": (
        "SELECT ticker, day, ts, open, high, low, close, volume, CASE WHEN s >= 14400 AND s < 34200 THEN 'PRE' WHEN s >= "
        "34200 AND s < 57600 THEN 'RTH' WHEN s >= 57600 AND s < 72000 THEN 'AFT' ELSE 'CLOSED' END AS session FROM sess"),
    "d": f"SELECT ticker, CAST(ts AS DATE) AS day, {_ROLL} FROM ticks GROUP BY 1, 2",
    "lt": (
        "SELECT l_returnflag AS ticker, CAST(l_shipdate AS TIMESTAMP) AS ts, "
        "l_extendedprice::DOUBLE / l_quantity::DOUBLE AS price, l_quantity::DOUBLE AS volume, (l_orderkey, l_linenumber, "
        "l_partkey, l_suppkey, l_extendedprice::DOUBLE, l_quantity::DOUBLE) AS seq FROM lineitem"),
    "ld": f"SELECT ticker, CAST(ts AS DATE) AS day, {_ROLL} FROM lt GROUP BY 1, 2",
    "agg0": (
        "SELECT ticker, day, session, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, "
        "count(*) AS bar_count, min(ts) AS first_ts, max(ts) AS last_ts, "
        "sum(CASE WHEN session = 'RTH' THEN (high + low + close) / 3.0::DOUBLE * coalesce(volume, "
        "0.0::DOUBLE) ELSE 0.0::DOUBLE END) AS sum_pv, sum(CASE WHEN session = 'RTH' THEN coalesce(volume, "
        "0.0::DOUBLE) ELSE 0.0::DOUBLE END) AS sum_v FROM b WHERE session <> 'CLOSED' GROUP BY 1, 2, 3"),
    "agg": "SELECT *, CASE WHEN sum_v > 0 THEN sum_pv / sum_v END AS vwap FROM agg0",
    "state": "SELECT ticker, day, " + ", ".join((
        f"{'coalesce(' * (c == 'bar_count')}max({c}) FILTER (session = '{s}'){', 0)' * (c == 'bar_count')} "
        f"AS {s.lower()}_{c}") for s in ("PRE", "RTH", "AFT") for c in ("high", "low", "close", "bar_count", "vwap")) + " FROM agg GROUP BY 1, 2",
    "orange": (
        "SELECT ticker, day, max(high) AS high, min(low) AS low, max(ts) AS last_ts FROM b "
        "WHERE session = 'RTH' AND hour(ts) * 3600 + minute(ts) * 60 < 36000 GROUP BY 1, 2"),
    "opening": (
        "SELECT ticker, day, 30 AS minutes, CAST(day AS TIMESTAMP) + INTERVAL 34200 SECONDS AS start_ts, "
        "CAST(day AS TIMESTAMP) + INTERVAL 36000 SECONDS AS end_ts, high, low, "
        "last_ts >= CAST(day AS TIMESTAMP) + INTERVAL 36000 SECONDS - INTERVAL 5 MINUTES AS complete FROM orange"),
    "tr": (
        "SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range "
        "FROM d WINDOW w AS (PARTITION BY ticker ORDER BY day)"),
    "atr": (
        "SELECT *, CASE WHEN count(true_range) OVER w = 14 THEN avg(true_range) OVER w END AS atr FROM tr "
        "WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"),
    "ltr": (
        "SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range "
        "FROM ld WINDOW w AS (PARTITION BY ticker ORDER BY day)"),
    "latr": (
        "SELECT *, CASE WHEN count(true_range) OVER w = 14 THEN avg(true_range) OVER w END AS atr FROM ltr "
        "WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"),
    "pday": (
        "SELECT s.ticker, s.day, x.day AS asof_day, x.high, x.low, x.close FROM (SELECT ticker, day FROM state) s ASOF "
        "JOIN d x ON s.ticker = x.ticker AND s.day > x.day"),
    "wk": (
        "SELECT ticker, day + CAST((12 - isodow(day)) % 7 AS INTEGER) AS day, max(high) AS high, min(low) AS low, "
        "arg_max(close, day) AS close FROM d GROUP BY ticker, 2"),
    "pweek": (
        "SELECT s.ticker, s.day, x.day AS asof_day, x.high, x.low, x.close FROM (SELECT ticker, day FROM state) s ASOF "
        "JOIN wk x ON s.ticker = x.ticker AND s.day > x.day"),
    "pv0": (
        "SELECT *, row_number() OVER o AS idx, count(*) OVER p = 2 AND count(*) OVER f = 2 AS whole, "
        "max(high) OVER p AS hp, max(high) OVER f AS hf, min(low) OVER p AS lp, min(low) OVER f AS lf FROM d "
        "WINDOW o AS (PARTITION BY ticker ORDER BY day), p AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 2 PRECEDING "
        "AND 1 PRECEDING), f AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)"),
    "pv1": (
        "SELECT ticker, day AS pivot_day, idx AS p, 'high' AS side, high AS price FROM pv0 "
        "WHERE whole AND high > hp AND high > hf UNION ALL SELECT ticker, day, idx, 'low', low FROM pv0 "
        "WHERE whole AND low < lp AND low < lf"),
    "pivots": (
        "SELECT a.ticker, a.day, v.side, v.price, v.pivot_day FROM pv0 a JOIN state s USING (ticker, day) "
        "JOIN pv1 v ON v.ticker = a.ticker AND v.p > a.idx - 118 AND v.p <= a.idx - 2"),
    "ctx": (
        "SELECT s.ticker, s.day, coalesce(nullif(s.rth_close, 0.0::DOUBLE), nullif(s.pre_close, 0.0::DOUBLE)) AS last, "
        "x.atr FROM state s ASOF LEFT JOIN atr x ON s.ticker = x.ticker AND s.day >= x.day"),
    "pfil": (
        "SELECT v.* FROM pivots v LEFT JOIN ctx c USING (ticker, day) "
        "WHERE NOT coalesce(abs(v.price - c.last) > 6.0::DOUBLE * c.atr, false)"),
    "pt0": (
        "SELECT *, row_number() OVER (PARTITION BY ticker, day, side ORDER BY CASE WHEN side = 'high' THEN -price ELSE "
        "price END) AS o FROM (SELECT DISTINCT ticker, day, side, price FROM pfil)"),
    "ptop": (
        "SELECT ticker, day, side, price, row_number() OVER (PARTITION BY ticker, day, side ORDER BY price) AS no, "
        "'sp_' || side[1] || '_' || row_number() OVER (PARTITION BY ticker, day, side ORDER BY price) AS id FROM pt0 "
        "WHERE o <= 12"),
    "lv_day": " UNION ALL ".join((
        f"SELECT ticker, day, {o} AS ord, '{i}' AS id, '{k}' AS kind, 'prior_day' AS source, "
        f"CAST(NULL AS VARCHAR) AS session, {c} AS price, {w} AS strength FROM pday") for o, i, k, c, w in ((1, "pd_h", "resistance", "high", 4), (2, "pd_l", "support", "low", 4), (3, "pd_c", "pivot", "close", 3))),
    "lv_week": " UNION ALL ".join((
        f"SELECT ticker, day, {o} AS ord, '{i}' AS id, '{k}' AS kind, 'prior_week' AS source, "
        f"CAST(NULL AS VARCHAR) AS session, {c} AS price, {w} AS strength FROM pweek") for o, i, k, c, w in ((4, "pw_h", "resistance", "high", 5), (5, "pw_l", "support", "low", 5), (6, "pw_c", "pivot", "close", 3))),
    "lv_pivot": (
        "SELECT ticker, day, CASE WHEN side = 'high' THEN 100 ELSE 200 END + no AS ord, id, "
        "CASE WHEN side = 'high' THEN 'resistance' ELSE 'support' END AS kind, 'swing_pivot' AS source, "
        "CAST(NULL AS VARCHAR) AS session, price, 2 AS strength FROM ptop"),
    "so": "SELECT s.*, o.high AS or_high, o.low AS or_low FROM state s LEFT JOIN opening o USING (ticker, day)",
    "lv_state": " UNION ALL ".join((
        f"SELECT ticker, day, {o} AS ord, '{i}' AS id, '{k}' AS kind, '{src}' AS source, "
        f"'{x}' AS session, {c} AS price, {w} AS strength FROM so WHERE {c} IS NOT NULL") for o, i, k, src, x, c, w in (
        (300, "rth_vwap", "anchor", "vwap", "RTH", "rth_vwap", 4), (301, "or_h", "resistance", "opening_range", "RTH", "or_high", 4), (302, "or_l", "support", "opening_range", "RTH", "or_low", 4),
        (310, "pre_h", "resistance", "session_extreme", "PRE", "pre_high", 3), (311, "pre_l", "support", "session_extreme", "PRE", "pre_low", 3), (312, "rth_h", "resistance", "session_extreme", "RTH", "rth_high", 3),
        (313, "rth_l", "support", "session_extreme", "RTH", "rth_low", 3), (314, "aft_h", "resistance", "session_extreme", "AFT", "aft_high", 3), (315, "aft_l", "support", "session_extreme", "AFT", "aft_low", 3),
        (320, "pm_h", "resistance", "premarket_context", "PRE", "pre_high", 1), (321, "pm_l", "support", "premarket_context", "PRE", "pre_low", 1))),
    "lv_all": "SELECT * FROM lv_day UNION ALL SELECT * FROM lv_week UNION ALL SELECT * FROM lv_pivot UNION ALL SELECT * FROM lv_state",
    "lv_one": (
        "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, day, source, round(price, 2), "
        "coalesce(session, '') ORDER BY strength DESC, ord) AS n, min(ord) OVER (PARTITION BY ticker, day, source, "
        "round(price, 2), coalesce(session, '')) AS pos FROM lv_all) WHERE n = 1"),
    "lv_top": (
        "SELECT * FROM (SELECT l.*, c.last, c.atr, row_number() OVER (PARTITION BY l.ticker, "
        "l.day ORDER BY strength DESC, coalesce(abs(price - c.last), 0.0::DOUBLE), pos) AS rank FROM lv_one l LEFT "
        "JOIN ctx c USING (ticker, day)) WHERE rank <= 40"),
    "lv": (
        "SELECT *, price - greatest(price * 0.0008::DOUBLE, CASE WHEN atr > 0 THEN atr * 0.2::DOUBLE END) AS zone_low, "
        "price + greatest(price * 0.0008::DOUBLE, CASE WHEN atr > 0 THEN atr * 0.2::DOUBLE END) AS zone_high FROM lv_top"),
    "f0": (
        "SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS ret, "
        "abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 12) OVER w) AS net, "
        "CASE WHEN lag(high) OVER w IS NOT NULL THEN coalesce(greatest(least(high, lag(high) OVER w) - greatest(low, "
        "lag(low) OVER w), 0.0::DOUBLE) / nullif(greatest(high, lag(high) OVER w) - least(low, lag(low) OVER w), "
        "0.0::DOUBLE), 0.0::DOUBLE) END AS share FROM b WINDOW w AS (PARTITION BY ticker ORDER BY ts)"),
    "f1": (
        "SELECT *, CASE WHEN count(ret) OVER v = 12 THEN stddev_samp(ret) OVER v END AS rv, "
        "net / nullif(CASE WHEN count(step) OVER v = 12 THEN sum(step) OVER v END, 0.0::DOUBLE) AS er, "
        "CASE WHEN count(share) OVER v = 12 THEN avg(share) OVER v END AS overlap FROM f0 "
        "WINDOW v AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"),
    "f5": (
        "SELECT f1.ticker, f1.day, ts, close, session, rv, er, overlap, (close - rth_vwap) / nullif(atr, "
        "0.0::DOUBLE) AS dist_vwap_atr, (close - rth_low) / nullif(rth_high - rth_low, 0.0::DOUBLE) AS pos_rth_range "
        "FROM f1 LEFT JOIN (SELECT c.ticker, c.day, atr, rth_vwap, rth_high, rth_low FROM ctx c "
        "JOIN state USING (ticker, day)) USING (ticker, day)"),
    "f5l": (
        "SELECT * EXCLUDE (n) FROM (SELECT ticker, day, ts AS asof_ts, close AS last_price, session, rv, er, overlap, "
        "dist_vwap_atr, pos_rth_range, row_number() OVER (PARTITION BY ticker, day ORDER BY ts DESC) AS n FROM f5) "
        "WHERE n = 1"),
    "press": (
        "SELECT b.ticker, b.day, b.ts, sum(CASE WHEN l.price > b.close THEN 1 ELSE -1 END * l.strength * (1 - "
        "abs(l.price - b.close) / l.atr)) AS pressure FROM b JOIN lv l USING (ticker, day) "
        "WHERE abs(l.price - b.close) <= l.atr GROUP BY 1, 2, 3"),
}


def _daily(src: str, atr: str, n: int = 20) -> dict[str, str]:
    return {
        f"{src}x": (
            f"SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS ret, "
            f"abs(close - lag(close) OVER w) AS step, abs(close - lag(close, {n}) OVER w) AS net, lag(close) OVER w AS prev, "
            f"row_number() OVER w::DOUBLE AS idx, count(*) OVER (PARTITION BY ticker) AS n_rows FROM {atr} "
            f"WINDOW w AS (PARTITION BY ticker ORDER BY day)"),
        f"{src}f": (
            f"SELECT ticker, day, open, high, low, close, volume, atr, n_rows, "
            f"CASE WHEN count(ret) OVER v = {n} THEN stddev_samp(ret) OVER v END AS rv, "
            f"net / nullif(CASE WHEN count(step) OVER v = {n} THEN sum(step) OVER v END, 0.0::DOUBLE) AS er, "
            f"CASE WHEN count(*) OVER v = {n} THEN regr_slope(close, idx) OVER v END AS slope_close, "
            f"CASE WHEN count(*) OVER v = {n} THEN (close - min(low) OVER v) / nullif(max(high) OVER v - min(low) OVER v, "
            f"0.0::DOUBLE) END AS pos_hhll, CASE WHEN count(*) OVER v = {n} THEN (volume - avg(volume) OVER v) / "
            f"nullif(stddev_samp(volume) OVER v, 0.0::DOUBLE) END AS vol_z, (high - low) / nullif(atr, "
            f"0.0::DOUBLE) AS range_atr, (open - prev) / nullif(atr, 0.0::DOUBLE) AS gap_atr FROM {src}x "
            f"WINDOW v AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"),
        f"{src}r0": f"SELECT *, slope_close / nullif(close, 0.0::DOUBLE) AS slope_n FROM {src}f",
        f"{src}r1": (
            f"SELECT *, CASE WHEN range_atr >= 1.35::DOUBLE THEN 'high_vol' WHEN er >= 0.55::DOUBLE AND slope_n >= "
            f"0.0003::DOUBLE THEN 'trend_up' WHEN er >= 0.55::DOUBLE AND slope_n <= -0.0003::DOUBLE THEN 'trend_down' WHEN er "
            f"<= 0.4::DOUBLE THEN 'range' ELSE 'transition' END AS regime FROM {src}r0"),
        f"{src}r": (
            f"SELECT *, lag(regime) OVER w AS regime_prev, coalesce(regime <> lag(regime) OVER w, true) AS changed "
            f"FROM {src}r1 WINDOW w AS (PARTITION BY ticker ORDER BY day)"),
    }


STEPS |= _daily("d", "atr") | _daily("ld", "latr")


def _central_z(p: float) -> float:
    """The approximation of the inverse normal that the operators use, for the middle of the distribution."""
    q, r = p - 0.5, (p - 0.5) ** 2
    a, b = 0.0, 0.0
    for x in PPF_A:
        a = a * r + x
    for x in (*PPF_B, 1.0):
        b = b * r + x
    return a * q / b


_Z = {"45": _central_z(0.725), "68": _central_z(0.84), "95": _central_z(0.975)}
STEPS |= {
    "n0": "SELECT f.*, s.rth_bar_count, c.atr, " + ", ".join((
        f"coalesce(nullif(CASE session WHEN 'PRE' THEN pre_{x} WHEN 'AFT' THEN aft_{x} ELSE rth_{x} END, 0.0::DOUBLE), "
        f"nullif(rth_{x}, 0.0::DOUBLE)) AS {x}_so_far") for x in ("low", "high")) + " FROM f5l f JOIN state s USING (ticker, day) LEFT JOIN ctx c USING (ticker, day)",
    "n1": (
        "SELECT * REPLACE (CASE WHEN session IN ('PRE', 'RTH', 'AFT') THEN session WHEN epoch(asof_ts - day::TIMESTAMP) "
        ">= 14400 AND epoch(asof_ts - day::TIMESTAMP) < 34200 THEN 'PRE' WHEN epoch(asof_ts - day::TIMESTAMP) >= 34200 "
        "AND epoch(asof_ts - day::TIMESTAMP) < 57600 THEN 'RTH' WHEN epoch(asof_ts - day::TIMESTAMP) >= 57600 AND "
        "epoch(asof_ts - day::TIMESTAMP) < 72000 THEN 'AFT' ELSE 'UNK' END AS session) FROM n0"),
    "n2": (
        "SELECT *, day::TIMESTAMP + to_seconds(CASE session WHEN 'PRE' THEN 34200 WHEN 'AFT' THEN 72000 ELSE 57600 END) "
        "AS end_ts FROM n1"),
    "n3": "SELECT *, greatest(ceil(epoch(end_ts - asof_ts) / 60.0::DOUBLE / 5), 0)::BIGINT AS bars_remaining FROM n2",
    "u0": (
        "SELECT range AS bar_index, 0.35::DOUBLE + 1.65::DOUBLE * pow(2 * abs((range + 0.5::DOUBLE) / 78 - 0.5::DOUBLE), "
        "1.35::DOUBLE) AS weight FROM range(78)"),
    "u": (
        "SELECT *, least(greatest(coalesce(sum(weight) OVER (ORDER BY bar_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED "
        "FOLLOWING), 0.0::DOUBLE) / sum(weight) OVER (), 0.0::DOUBLE), 1.0::DOUBLE) AS remaining FROM u0"),
    "n4": (
        "SELECT n.*, CASE WHEN session = 'RTH' THEN u.remaining ELSE least(greatest(bars_remaining / 78.0::DOUBLE, "
        "0.0::DOUBLE), 1.0::DOUBLE) END AS remaining_var_frac FROM n3 n LEFT "
        "JOIN u ON u.bar_index = greatest(least(78 - bars_remaining, 77), 0)"),
    "n5": (
        "SELECT *, CASE WHEN rv > 0 AND bars_remaining > 0 THEN last_price * rv * sqrt(bars_remaining) END AS "
        "sigma_intraday, CASE WHEN atr > 0 THEN atr * sqrt(remaining_var_frac) END AS sigma_atr, "
        "least(greatest(coalesce(rth_bar_count::DOUBLE, 0.0::DOUBLE) / 78, 0.0::DOUBLE), 1.0::DOUBLE) AS blend_weight, "
        "CAST(asof_ts AS DATE) <> day AS is_stale FROM n4"),
    "n6": (
        "SELECT *, CASE WHEN sigma_intraday IS NOT NULL AND sigma_atr IS NOT NULL THEN sqrt(blend_weight * "
        "sigma_intraday * sigma_intraday + (1 - blend_weight) * sigma_atr * sigma_atr) ELSE coalesce(sigma_intraday, "
        "sigma_atr) END AS sig0, CASE WHEN sigma_intraday IS NOT NULL AND sigma_atr IS NOT NULL THEN 'blend_var' WHEN "
        "sigma_intraday IS NOT NULL THEN 'intraday_only' WHEN sigma_atr IS NOT NULL THEN 'atr_only' END AS sigma_source "
        "FROM n5"),
    "n7": "SELECT *, CASE WHEN sig0 IS NOT NULL THEN greatest(sig0, CASE WHEN atr > 0 THEN atr * 0.1::DOUBLE END) END AS sigma_pts FROM n6",
    "n8": "SELECT *, " + ", ".join(f"last_price - {z}::DOUBLE * sigma_pts AS rem_low_{n}, last_price + {z}::DOUBLE * sigma_pts AS rem_high_{n}" for n, z in (("68", 1.0), ("95", 1.96))) + " FROM n7",
    "today": "SELECT *, " + ", ".join((
        f"rem_high_{n} - rem_low_{n} AS rem_width_{n}, least(low_so_far, rem_low_{n}) AS day_low_{n}, "
        f"greatest(high_so_far, rem_high_{n}) AS day_high_{n}, greatest(high_so_far, rem_high_{n}) - least(low_so_far, "
        f"rem_low_{n}) AS day_width_{n}") for n in ("68", "95")) + " FROM n8",
    "nl0": (
        "SELECT t.ticker, t.day, t.last_price, l.*, greatest(zone_low - last_price, last_price - zone_high, "
        "0.0::DOUBLE) AS dist FROM today t LEFT JOIN (SELECT ticker AS lt, day AS ldd, rank, id, kind, source, zone_low, "
        "zone_high, strength FROM lv) l ON l.lt = t.ticker AND l.ldd = t.day"),
    "nl": "SELECT ticker, day, " + ", ".join(f"arg_min({c}, (dist, rank)) FILTER ({w}) AS {s}_{c}" for s, w in (("sup", "kind IN ('support', 'pivot', 'anchor') AND zone_low <= last_price"), ("res", "kind IN ('resistance', 'pivot', 'anchor') AND zone_high >= last_price")) for c in ("dist", "id", "kind", "source", "zone_low", "zone_high", "strength")) + " FROM nl0 GROUP BY 1, 2",
    "i0": "SELECT t.*, n.* EXCLUDE (ticker, day), " + ", ".join(f"n.{s}_dist / nullif(atr, 0.0::DOUBLE) AS {s}_dist_atr, coalesce(nullif(n.{s}_id, ''), n.{s}_source) AS {s}_name" for s in ("sup", "res")) + (
        ", sigma_pts / nullif(atr, 0.0::DOUBLE) AS sigma_rem_atr FROM today t LEFT JOIN nl n USING (ticker, day) "
        "WHERE atr > 0"),
    "i1": "SELECT *, " + ", ".join((
        f"CASE WHEN {c} IS NULL THEN 0.0::DOUBLE ELSE least(greatest(({c} - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE), "
        f"0.0::DOUBLE), 1.0::DOUBLE) END AS {n}") for c, a, b, n in (("er", 0.45, 0.60, "trend"), ("overlap", 0.45, 0.62, "chop"), ("sigma_rem_atr", 0.18, 0.45, "vol"))) + ", " + ", ".join((
        f"CASE WHEN {s}_dist_atr IS NULL THEN 0.0::DOUBLE ELSE least(greatest(greatest(0.0::DOUBLE, "
        f"1 - {s}_dist_atr / 0.25::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(least(greatest(({s}_strength - 1) / "
        f"4.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE) END AS near_{s}") for s in ("sup", "res")) + " FROM i0",
    "i2": (
        "SELECT *, greatest(near_sup, near_res) AS near_any, CASE WHEN coalesce(sup_dist_atr <= 0, "
        "false) OR coalesce(res_dist_atr <= 0, false) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS inside_bonus, "
        "CASE WHEN rem_high_68 > rem_low_68 THEN (last_price - rem_low_68) / (rem_high_68 - rem_low_68) END AS pos_68 "
        "FROM i1"),
    "i3": (
        "SELECT *, 1 / (1 + exp(-(1.1::DOUBLE * chop + 0.7::DOUBLE * near_any + 0.5::DOUBLE * (1 - vol) + inside_bonus - "
        "1))) AS stall, coalesce(0.35::DOUBLE * (pos_68 - 0.5::DOUBLE), 0.0::DOUBLE) AS tilt FROM i2"),
    "i4": (
        "SELECT *, 1 / (1 + exp(-(1.1::DOUBLE * trend + 0.8::DOUBLE * vol + 0.65::DOUBLE * near_res - 0.75::DOUBLE * "
        "chop + tilt))) * (1 - 0.55::DOUBLE * stall) AS breakout_up, 1 / (1 + exp(-(1.1::DOUBLE * trend + 0.8::DOUBLE * "
        "vol + 0.65::DOUBLE * near_sup - 0.75::DOUBLE * chop - tilt))) * (1 - 0.55::DOUBLE * stall) AS breakout_down "
        "FROM i3"),
    "i5": (
        "SELECT *, coalesce(bars_remaining > 0 AND bars_remaining <= 6, false) AS late, "
        "coalesce(sigma_rem_atr < 0.18::DOUBLE, false) AS low_move FROM i4"),
    "i6": (
        "SELECT *, NOT (late OR low_move) AND coalesce(overlap >= 0.62::DOUBLE, "
        "false) AND (er IS NULL OR er < 0.45::DOUBLE) AS mean_reversion_preferred FROM i5"),
    "i7": (
        "SELECT *, NOT (late OR low_move) AND NOT mean_reversion_preferred AND breakout_up >= 0.62::DOUBLE AND "
        "breakout_up > breakout_down AS up, NOT (late OR low_move) AND NOT mean_reversion_preferred AND breakout_down >= "
        "0.62::DOUBLE AND breakout_down > breakout_up AS down FROM i6"),
    "i8": (
        "SELECT *, NOT (late OR low_move) AND coalesce(sigma_rem_atr >= 0.45::DOUBLE, "
        "false) AND NOT (up OR down) AS unclear, stall >= 0.7::DOUBLE AS stalled FROM i7"),
    "i9": (
        "SELECT *, CASE WHEN mean_reversion_preferred THEN 'range/mean_reversion' WHEN up THEN 'bullish_breakout' WHEN "
        "down THEN 'bearish_breakout' ELSE 'neutral' END AS trade_bias, "
        "(up OR down) AND NOT stalled AS directional_premium_allowed, mean_reversion_preferred OR unclear AS "
        "prefer_spreads, late OR low_move OR (stalled AND NOT mean_reversion_preferred) AS avoid_trading FROM i8"),
    "why": (
        "SELECT *, list_filter([CASE WHEN late THEN 'R_LATE_SESSION|' || bars_remaining END, "
        "CASE WHEN low_move THEN 'R_LOW_REMAINING_MOVE|' || coalesce(printf('%.3f', sigma_rem_atr), 'NA') END, "
        "CASE WHEN mean_reversion_preferred THEN 'R_CHOPPY_TAPE' END, CASE WHEN mean_reversion_preferred THEN "
        "'R_OVERLAP_ER|' || coalesce(printf('%.3f', overlap), 'NA') || '|' || coalesce(printf('%.3f', er), 'NA') END, "
        "CASE WHEN up THEN 'R_BREAKOUT_UP_ELEVATED|' || printf('%.2f', breakout_up) END, "
        "CASE WHEN down THEN 'R_BREAKOUT_DOWN_ELEVATED|' || printf('%.2f', breakout_down) END, "
        "CASE WHEN unclear THEN 'R_HIGH_VOL_UNCLEAR_DIR' END, CASE WHEN stalled THEN 'R_STALL_HIGH_NEAR_LEVELS|' || "
        "printf('%.2f', stall) END], lambda x: x IS NOT NULL) AS notes FROM i9"),
    "rc": "SELECT *, " + ", ".join((
        f"{'coalesce(rem_low_' + n + ', ' if n != '45' else ''}last_price - {z}::DOUBLE * CASE WHEN sigma_pts > 0 THEN "
        f"sigma_pts END{')' if n != '45' else ''} AS "
        f"ctx_low_{n}, {'coalesce(rem_high_' + n + ', ' if n != '45' else ''}last_price + {z}::DOUBLE * CASE WHEN "
        f"sigma_pts > 0 THEN sigma_pts END{')' if n != '45' else ''} AS ctx_high_{n}") for n, z in _Z.items()) + (
        ", CASE WHEN sigma_pts > 0 THEN 0.5::DOUBLE END AS pos_in_45, CASE WHEN sigma_pts > 0 THEN 0.5::DOUBLE END AS "
        "pos_in_68, CASE WHEN sigma_pts > 0 THEN 0.5::DOUBLE END AS pos_in_95 FROM why"),
    "cb": (
        "SELECT ticker, day, prob, z, last_price - z * sigma_pts AS low, last_price + z * sigma_pts AS high "
        "FROM today, (VALUES ") + ", ".join(f"({int(k) / 100}::DOUBLE, {v}::DOUBLE)" for k, v in _Z.items()) + ") AS v(prob, z) WHERE sigma_pts > 0",
    "t0": (
        "SELECT ticker, day, close, atr, rv, gap_atr, coalesce(regime, 'transition') AS regime, "
        "CASE WHEN close IS NOT NULL AND atr > 1e-6::DOUBLE THEN 'ok' WHEN close IS NULL THEN 'no close' ELSE 'no atr' "
        "END AS status FROM dr"),
    "t1": (
        "SELECT *, CASE WHEN status = 'ok' THEN atr * CASE regime WHEN 'trend_up' THEN 1.05::DOUBLE WHEN 'trend_down' "
        "THEN 1.05::DOUBLE WHEN 'range' THEN 0.9::DOUBLE WHEN 'high_vol' THEN 1.3::DOUBLE ELSE 1.15::DOUBLE END END AS "
        "sigma_pts FROM t0"),
    "tom": "SELECT *, " + ", ".join(f"close {s} {z}::DOUBLE * sigma_pts AS {side}_{n}" for n, z in (("45", 0.55), ("68", 1.0), ("95", 2.0)) for side, s in (("low", "-"), ("high", "+"))) + ", day + CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next_day FROM t1",
    "notes": (
        "SELECT *, list_filter([CASE WHEN regime IN ('high_vol', 'transition') THEN 'Regime=' || regime || ': consider "
        "wider error bars and defined-risk structures.' END, CASE WHEN abs(gap_atr) >= 0.8::DOUBLE THEN printf('Large "
        "gap vs ATR (gap_atr=%.2f): open may be discontinuous.', gap_atr) END, "
        "CASE WHEN rv >= 0.02::DOUBLE THEN printf('Elevated realized vol proxy (rv=%.3f).', rv) END, "
        "CASE WHEN atr <= 0 THEN 'ATR invalid (should not happen).' END], lambda x: x IS NOT NULL) AS note_list FROM tom"),
    "kl0": (
        "SELECT l.ticker, l.day, l.rank, l.id, l.kind, l.source, l.zone_low, l.zone_high, l.strength, "
        "CASE WHEN (zone_low + zone_high) / 2 <= t.close THEN 'support' ELSE 'resistance' END AS side, "
        "abs((zone_low + zone_high) / 2 - t.close) AS dist_pts FROM lv l JOIN tom t USING (ticker, day)"),
    "kl": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, day, side ORDER BY dist_pts, rank) AS place "
        "FROM kl0) WHERE place <= 6"),
    "ts0": (
        "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_set FROM ldr "
        "WHERE regime IS NOT NULL AND n_rows >= 60) WHERE n_set >= 300"),
    "ts": (
        "SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY day DESC) <= greatest(1, "
        "CAST(round(n_set * 0.2::DOUBLE) AS INTEGER)) THEN 'holdout' ELSE 'train' END AS split FROM ts0"),
    "pred": (
        "SELECT ticker, day, regime, CASE WHEN er >= 0.5::DOUBLE THEN 'trend_up' WHEN range_atr >= 1.2::DOUBLE THEN "
        "'high_vol' ELSE 'range' END AS prediction FROM ts WHERE split = 'holdout'"),
    "plab": "SELECT DISTINCT ticker, regime AS l FROM pred UNION SELECT DISTINCT ticker, prediction FROM pred",
    "conf": (
        "SELECT a.ticker, a.l AS regime, p.l AS prediction, coalesce(n, 0) AS n FROM plab a "
        "JOIN plab p ON a.ticker = p.ticker LEFT JOIN (SELECT ticker, regime, prediction, count(*) AS n FROM pred "
        "GROUP BY 1, 2, 3) c ON c.ticker = a.ticker AND c.regime = a.l AND c.prediction = p.l"),
    "rep": (
        "SELECT ticker, label, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE "
        "0.0::DOUBLE END AS f1, support FROM (SELECT t.ticker, t.label, "
        "CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0.0::DOUBLE END AS p, "
        "CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0::DOUBLE END AS r, support "
        "FROM (SELECT ticker, regime AS label, sum(n) AS support, sum(n) FILTER (regime = prediction) AS tp FROM conf "
        "GROUP BY 1, 2) t JOIN (SELECT ticker, prediction AS label, sum(n) AS predicted FROM conf "
        "GROUP BY 1, 2) s USING (ticker, label))"),
}


#: The nowcast of every bar: the same steps, from all bars in place of the newest of a day.
_EACH = re.compile(r"\b(f5l|n[0-8]|today)\b")
STEPS |= {
    "e_f5l": "SELECT ticker, day, ts AS asof_ts, close AS last_price, session, rv, er, overlap, dist_vwap_atr, pos_rth_range FROM f5",
    **{f"e_{n}": _EACH.sub(r"e_\1", STEPS[n]) for n in (*(f"n{i}" for i in range(9)), "today")},
    "risk_items": "SELECT ticker, day, unnest(list_filter([CASE WHEN regime IN ('high_vol', 'transition') THEN 'N_REGIME|' || regime END, "
    "CASE WHEN abs(gap_atr) >= 0.8::DOUBLE THEN 'N_GAP|' || printf('%.2f', gap_atr) END, CASE WHEN rv >= 0.02::DOUBLE THEN 'N_RV|' || printf('%.3f', rv) END, "
    "CASE WHEN atr <= 0 THEN 'N_ATR' END], lambda x: x IS NOT NULL)) AS item FROM tom",
}


def select(spec: str, step: str, where: str = "") -> str:
    """SQL that selects columns of a step: name* rounds to six places, name# is a BIGINT, a=b renames b to a."""
    out = []
    for c in spec.split():
        kind, c = (c[-1], c[:-1]) if c[-1] in "*#" else ("", c)
        name, _, expr = c.partition("=")
        expr = expr or name
        out.append((f"floor({expr} * 1000000::DOUBLE + 0.501::DOUBLE) / 1000000::DOUBLE" if kind == "*" else f"CAST({expr} AS BIGINT)" if kind == "#" else expr) + f" AS {name}")
    return query(f"SELECT {', '.join(out)} FROM {step} {where}")


def query(sql: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in STEPS.items()) + "\n" + sql
