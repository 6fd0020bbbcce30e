"""Pattern, strategy, idea and session queries, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import exchange_days as ex
from barspark.functions import sessions as se
from barspark.operators import patterns as pt
from barspark.operators import shapes as sh
from barspark.operators import research_run as rr
from barspark.operators import strategies as sg
from barspark.plans import sql
from barspark.plans.indicator_queries import ADX_CTES, COMPRESSION_CTE, FLAGS_CTE
from barspark.plans.research_queries import RSI
from barspark.plans.structure_queries import DISP_CTE, DOUBLES_CTE, FVG_CTE, LAST, LEVELS_CTE, SWINGS
from barspark.sources.bars import hourly, ticks


def _rounded(rows, *columns):
    for c in columns:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


def _releases(spark, sf_dir):
    return ticks(spark, sf_dir).filter("instrument = 'error'").select(F.col("ts").alias("at"))


def _prepared(spark, sf_dir):
    return sg.prepared(hourly(spark, sf_dir), ticks(spark, sf_dir))


def all_patterns(spark, sf_dir):
    return _rounded(pt.ranked(_rounded(pt.patterns(hourly(spark, sf_dir), ticks(spark, sf_dir)), "confidence")), "confidence")


def strategy_entries(spark, sf_dir):
    found = sg.entries(_prepared(spark, sf_dir), [sg.build(name) for name in sg.LIBRARY])
    return _rounded(found.select("instrument", "i", "strategy", "direction", "entry", "stop", "target"), "stop", "target")


def research_verdicts(spark, sf_dir):
    """Verdicts on all strategies: entries followed for twenty bars, net of costs, seven tenths of every series against the rest."""
    bars = hourly(spark, sf_dir)
    found = sg.entries(_prepared(spark, sf_dir), [sg.build(name) for name in sg.LIBRARY])
    return _rounded(rr.verdicts(rr.measured(found, bars), bars), "net_train", "net_oos", "won_train", "won_oos", "t")


def stop_variants(spark, sf_dir):
    found = sg.entries(_prepared(spark, sf_dir), [sg.with_stop(sg.build("vwap_trend"), v) for v in sg.STOPS])
    return _rounded(found.select("instrument", "i", "strategy", "direction", "stop"), "stop")


def _judged(spark, sf_dir):
    rows = sg.covered_blackout(sg.ideas(_prepared(spark, sf_dir)), _releases(spark, sf_dir), 30, 15, F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"))
    return sg.judged(rows)


def judged_ideas(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    return _rounded(rows.select("instrument", "i", "setup", "kind", "direction", "reward_risk", F.array_join("reasons", ",").alias("reasons"), F.array_join("unchecked", ",").alias("unchecked"), "rejected"), "reward_risk")


def idea_counts(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    return rows.groupBy("setup").pivot("rejected", [False, True]).agg(F.count(F.lit(1))).select("setup", F.coalesce("false", F.lit(0).cast("long")).alias("kept"), F.coalesce("true", F.lit(0).cast("long")).alias("rejected"))


def idea_audit(spark, sf_dir):
    """Ideas of which some are written with another time, entry or stop than the bars give."""
    rows = _prepared(spark, sf_dir)
    written = sg.ideas(rows).select("instrument", "i", "ts", "setup", "direction", "entry", "stop", "target")
    k = F.col("i") % 5
    written = written.withColumn("ts", F.when(k == 0, F.col("ts") + F.expr("interval 30 minutes")).otherwise(F.col("ts")))
    written = written.withColumn("entry", F.when(k == 1, F.col("entry") + 1).otherwise(F.col("entry"))).withColumn("stop", F.when(k == 2, F.col("stop") - 1).otherwise(F.col("stop")))
    return sg.audited(written, rows).select("instrument", "i", "setup", "direction", "audit")


def session_flags(spark, sf_dir):
    ts = F.col("ts")
    first, end = se.session_bounds(se.session_date(ts))
    return hourly(spark, sf_dir).select(
        "instrument", "i", first.alias("session_start"), end.alias("session_end"), se.floor_to(ts, 240).alias("floor_4h"), se.minutes_until_rth_close(ts).alias("to_rth_close"), se.minutes_until_maintenance(ts).alias("to_maintenance"),
        se.is_liquid(ts).alias("liquid"), se.is_first_hour(ts).alias("first_hour"), se.is_thin(ts).alias("thin"), se.is_overnight(ts).alias("overnight"), se.minutes_from_rth_open(ts).alias("from_rth_open"),
    )


def trading_days(spark, sf_dir):
    day = F.to_date("o_orderdate")
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(day.alias("day")).distinct()
    return days.select("day", ex.is_trading_day(F.col("day")).alias("trading"), ex.is_early_close(F.col("day")).alias("early"), ex.next_trading_day(F.col("day")).alias("next_day"))


# -- SQL ------------------------------------------------------------------------------------------

BREAKS_OF_SWINGS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS}, {DISP_CTE}, {FVG_CTE},
ks AS (SELECT *, lag(kind) OVER w AS k0, lag(price) OVER w AS p0 FROM swings WINDOW w AS (PARTITION BY instrument ORDER BY i, kind)),
fb AS (SELECT ks.*, b.i AS b_i FROM ks JOIN bars b ON b.instrument = ks.instrument AND b.i > ks.available AND CASE WHEN kind = 'high' THEN b.close > price ELSE b.close < price END QUALIFY row_number() OVER (PARTITION BY ks.instrument, ks.kind, ks.i ORDER BY b.i) = 1),
fd AS (SELECT instrument, i AS swing_i, price AS level, b_i AS i, CAST(CASE WHEN kind = 'high' THEN 1 ELSE -1 END AS BIGINT) AS direction, coalesce(kind = k0 AND CASE WHEN kind = 'high' THEN price < p0 ELSE price > p0 END, false) AS inner_ FROM fb),
fe AS (SELECT fd.*, EXISTS (SELECT 1 FROM disp d WHERE d.instrument = fd.instrument AND d.i = fd.i AND d.direction = fd.direction) AS displacement, EXISTS (SELECT 1 FROM fvg g WHERE g.instrument = fd.instrument AND g.i = fd.i AND g.direction = fd.direction) AS gap FROM fd)
SELECT instrument, swing_i, level, i, direction, CASE WHEN NOT inner_ THEN 'bos' WHEN displacement OR gap THEN 'mss' ELSE 'choch' END AS break_type, displacement, gap FROM fe"""

_CLAMP = "greatest(0.0, least(1.0, {x}))"
_LEVELS = "[pdh, pdl, pdc, ib_high, ib_low, onh, onl, or5_high, or5_low, or15_high, or15_low, or30_high, or30_low, swing_high, swing_low]"

PATTERNS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {sql.TICKS}, {LAST}, {LEVELS_CTE}, {FLAGS_CTE}, {COMPRESSION_CTE}, {DOUBLES_CTE},
pb AS (SELECT lw.instrument, lw.i, lw.open, lw.close, lw.high, lw.low, a, lag(lw.open) OVER o AS po, lag(lw.close) OVER o AS pc, {_LEVELS} AS lvls, flag_up, flag_down, flag_direction, flag_forming, flag_range, flag_impulse, rn, ru,
    high_price, high_before, low_price, low_before, high_before_origin, low_before_origin FROM lw JOIN flz USING (instrument, i) JOIN rc USING (instrument, i) JOIN ls USING (instrument, i) WINDOW o AS (PARTITION BY lw.instrument ORDER BY lw.i)),
pc AS (SELECT *, abs(close - open) AS body, abs(pc - po) AS before, high - low AS span, high - greatest(open, close) AS up, least(open, close) - low AS dn, coalesce(a > 0 AND list_min(list_transform(list_filter(lvls, lambda x: x IS NOT NULL), lambda x: abs(x - close))) <= 0.35 * a, false) AS near,
    0.3 * coalesce(a, 0) AS tol, high_price - high_before AS td, low_price - low_before AS bd, high_before - low_before AS was FROM pb),
pd AS (SELECT *, CASE WHEN i - high_before_origin < 120 AND i - low_before_origin < 120 AND was > 0 THEN CASE WHEN td < -tol AND bd > tol THEN 'triangle_symmetric' WHEN abs(td) <= tol AND bd > tol THEN 'triangle_ascending' WHEN td < -tol AND abs(bd) <= tol THEN 'triangle_descending' END END AS tri FROM pc),
pe AS (SELECT instrument, i, CASE WHEN flag_up OR flag_down THEN 'flag_breakout' ELSE 'flag_forming' END AS pattern, CASE WHEN flag_up THEN 1 WHEN flag_down THEN -1 ELSE flag_direction END AS direction, {_CLAMP.format(x="0.5 + 0.1 * (abs(flag_impulse) / flag_range - 2)")} AS confidence FROM pd WHERE flag_direction <> 0 AND flag_range > 0 AND (flag_up OR flag_down OR flag_forming)
    UNION ALL SELECT instrument, i, tri, CASE tri WHEN 'triangle_ascending' THEN 1 WHEN 'triangle_descending' THEN -1 ELSE 0 END, {_CLAMP.format(x="1.5 * (1 - (high_price - low_price) / was)")} FROM pd WHERE tri IS NOT NULL
    UNION ALL SELECT instrument, i, 'compression', 0, {_CLAMP.format(x="1 - rn / ru / 0.6")} FROM pd WHERE rn / nullif(ru, 0) <= 0.6
    UNION ALL SELECT instrument, i, 'engulfing', CASE WHEN close > open THEN 1 ELSE -1 END, {_CLAMP.format(x="0.3 + 0.15 * (body / before - 1)")} FROM pd WHERE near AND before > 0 AND body > before AND (close > open) <> (pc > po) AND least(open, close) <= least(po, pc) AND greatest(open, close) >= greatest(po, pc)
    UNION ALL SELECT instrument, i, 'pin_bar', CASE WHEN dn >= 2 * body AND dn >= 0.5 * span THEN 1 ELSE -1 END, {_CLAMP.format(x="0.25 + 0.1 * (CASE WHEN dn >= 2 * body AND dn >= 0.5 * span THEN dn ELSE up END / body - 2)")} FROM pd WHERE near AND span > 0 AND body > 0 AND ((dn >= 2 * body AND dn >= 0.5 * span) OR (up >= 2 * body AND up >= 0.5 * span))
    UNION ALL SELECT instrument, available, pattern, CASE WHEN pattern = 'double_bottom' THEN 1 ELSE -1 END, confidence FROM dbl)
SELECT instrument, i, pattern, CAST(direction AS BIGINT) AS direction, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY instrument, i ORDER BY round(confidence, 6) DESC, pattern, direction) AS rank FROM pe"""

#: spx has every column that the strategies read, and those of the bar before.
PREPARED_CTE = f"""{ADX_CTES}, {sql.TICKS}, {LAST}, {LEVELS_CTE}, {FLAGS_CTE}, {RSI}, {DOUBLES_CTE},
sv AS (SELECT *, (high + low + close) / 3 AS tp FROM lw),
sw1 AS (SELECT sv.*, coalesce(sum(tp * volume) OVER v / nullif(sum(volume) OVER v, 0), tp) AS vwap, CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY instrument ORDER BY i ROWS 19 PRECEDING) END AS sma20, CASE WHEN i >= 49 THEN avg(close) OVER (PARTITION BY instrument ORDER BY i ROWS 49 PRECEDING) END AS sma50 FROM sv WINDOW v AS (PARTITION BY instrument, session ORDER BY i)),
dw AS (SELECT instrument, available AS i, max(confidence) FILTER (pattern = 'double_bottom') AS w_confidence, arg_max(price, confidence) FILTER (pattern = 'double_bottom') AS w_second, bool_or(pattern = 'double_bottom') AS w_found, arg_max(price, confidence) FILTER (pattern = 'double_top') AS m_second, bool_or(pattern = 'double_top') AS m_found FROM dbl GROUP BY 1, 2),
db AS (SELECT instrument, break_i AS i, bool_or(pattern = 'double_bottom') AS w_break, bool_or(pattern = 'double_top') AS m_break FROM dbl WHERE break_i IS NOT NULL GROUP BY 1, 2),
sj AS (SELECT sw1.*, rsi, adx.y AS adx, flag_up, flag_down, ls.low_before, ls.high_before, w_second, m_second, coalesce(w_found, false) AS w_found, coalesce(m_found, false) AS m_found, coalesce(w_break, false) AS w_break, coalesce(m_break, false) AS m_break, {sql.LOCAL.format(ts="sw1.ts")} AS ny
    FROM sw1 JOIN rsi USING (instrument, i) LEFT JOIN adx USING (instrument, i) JOIN flz USING (instrument, i) JOIN ls USING (instrument, i) LEFT JOIN dw USING (instrument, i) LEFT JOIN db USING (instrument, i)),
spx AS (SELECT *, hour(ny) * 60 + minute(ny) BETWEEN 570 AND 945 AS day_, hour(ny) * 60 + minute(ny) BETWEEN 900 AND 955 AS late, lag(close) OVER o AS pc, lag(pdh) OVER o AS ppdh, lag(pdl) OVER o AS ppdl, lag(rsi) OVER o AS prsi, lag(vwap) OVER o AS pv, lag(ib_high) OVER o AS pibh, lag(ib_low) OVER o AS pibl, lag(a) OVER o AS pa FROM sj WINDOW o AS (PARTITION BY instrument ORDER BY i))"""

_REENTRY = "pa > 0 AND a > 0 AND {s} * (pc - pv) >= {m} * pa AND {s} * (close - vwap) < {m} * a AND {s} * (close - vwap) > 0"
#: Strategy: conditions of either side, stop and target in ATR.
_ENTRIES = {
    "prev_day_breakout": ("pc <= ppdh AND close > pdh + 1 AND rsi < 70 AND day_", "pc >= ppdl AND close < pdl - 1 AND rsi > 30 AND day_", 1.5, 3.0),
    "rsi_mean_reversion": ("prsi <= 30 AND rsi > 30 AND day_", "prsi >= 70 AND rsi < 70 AND day_", 2.0, None),
    "flag_breakout": ("flag_up AND day_ AND sma20 > sma50", "flag_down AND day_ AND sma20 < sma50", 1.2, 2.5),
    "vwap_trend": ("pc <= pv AND close > vwap AND sma20 > sma50 AND day_", "pc >= pv AND close < vwap AND sma20 < sma50 AND day_", 1.5, 3.0),
    "ib_breakout": ("pc <= pibh AND close > ib_high + 1 AND day_", "pc >= pibl AND close < ib_low - 1 AND day_", 1.5, 3.0),
    "vwap_reversion": (_REENTRY.format(s=-1, m=1.5) + " AND day_", _REENTRY.format(s=1, m=1.5) + " AND day_", 1.5, 2.0),
    "power_hour_vwap": (_REENTRY.format(s=-1, m=2.0) + " AND late", _REENTRY.format(s=1, m=2.0) + " AND late", 1.5, 3.0),
    "double_confirmed": ("w_found AND day_", "m_found AND day_", 1.5, 3.0),
    "double_neck_break": ("w_break AND day_", "m_break AND day_", 1.5, 3.0),
}
_STOPS = {"atr": ("NULL", "NULL"), "last_swing": ("swing_low", "swing_high"), "second_last_swing": ("low_before", "high_before"), "previous_day": ("pdl", "pdh"), "pattern": ("w_second", "m_second")}


def _entries(names, stops=("NULL", "NULL"), suffix="") -> str:
    parts = []
    for name in names:
        *sides, stop, target = _ENTRIES[name]
        for d, condition, column in zip((1, -1), sides, stops, strict=True):
            at = f"close - {d} * {stop} * a"
            aim = "CAST(NULL AS DOUBLE)" if target is None else f"close + {d} * {target} * a"
            parts.append(f"SELECT instrument, i, ts, '{name}{suffix}' AS strategy, CAST({d} AS BIGINT) AS direction, close AS entry, coalesce(CASE WHEN (close - {column}) * {d} > 0 THEN {column} END, {at}) AS stop, {aim} AS target, adx FROM spx WHERE a > 0 AND ({condition})")
    return " UNION ALL ".join(parts)


ENTRIES = f"WITH RECURSIVE {sql.BARS}, {PREPARED_CTE}, en AS ({_entries(_ENTRIES)}) SELECT instrument, i, strategy, direction, entry, round(stop, 6) AS stop, round(target, 6) AS target FROM en"
VARIANTS = f"WITH RECURSIVE {sql.BARS}, {PREPARED_CTE}, en AS ({' UNION ALL '.join(_entries(['vwap_trend'], s, '@' + v) for v, s in _STOPS.items())}) SELECT instrument, i, strategy, direction, round(stop, 6) AS stop FROM en"

_NAMES = "CASE strategy WHEN 'prev_day_breakout' THEN 'prev_day_break' WHEN 'ib_breakout' THEN 'ib_break' WHEN 'vwap_reversion' THEN 'vwap_reversion' ELSE 'flag_break' END"
IDEAS_CTE = f"""en AS ({_entries(["prev_day_breakout", "ib_breakout", "vwap_reversion", "flag_breakout"])}),
ix AS (SELECT *, {_NAMES} AS setup, CASE WHEN strategy = 'vwap_reversion' THEN 'reversion' ELSE 'continuation' END AS kind FROM en)"""

JUDGED_CTE = f"""{IDEAS_CTE}, rel AS (SELECT DISTINCT ts AS rel FROM events WHERE event_type = 'error'), iy AS (SELECT *, ts - INTERVAL 15 MINUTE AS since FROM ix),
iz AS (SELECT iy.*, CASE WHEN ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' THEN coalesce(rel <= ts + INTERVAL 30 MINUTE, false) END AS blackout, {sql.LOCAL.format(ts="ts")} AS ny, timezone('America/Chicago', timezone('UTC', ts)) AS ch FROM iy ASOF LEFT JOIN rel ON iy.since <= rel.rel),
ja AS (SELECT *, hour(ny) * 60 + minute(ny) AS m, isodow(ny) <= 5 AS workday, NOT (isodow(ch) = 6 OR (isodow(ch) = 5 AND hour(ch) >= 16) OR (isodow(ch) = 7 AND hour(ch) < 17) OR hour(ch) = 16) AS open_ FROM iz),
jb AS (SELECT *, concat_ws(',', CASE WHEN kind = 'continuation' AND adx < 20 THEN 'adx_too_low' END, CASE WHEN kind = 'reversion' AND adx > 25 THEN 'adx_too_high' END, CASE WHEN NOT (open_ AND workday AND m BETWEEN 570 AND 959) THEN 'outside_liquid_hours' END, CASE WHEN m BETWEEN 720 AND 839 THEN 'thin_hours' END, CASE WHEN blackout THEN 'blackout' END) AS reasons,
    concat_ws(',', CASE WHEN adx IS NULL THEN 'adx' END, CASE WHEN blackout IS NULL THEN 'blackout' END) AS unchecked FROM ja)"""
JUDGED = f"WITH RECURSIVE {sql.BARS}, {PREPARED_CTE}, {JUDGED_CTE} SELECT instrument, i, setup, kind, direction, round(abs(target - entry) / nullif(abs(entry - stop), 0), 6) AS reward_risk, reasons, unchecked, reasons <> '' AS rejected FROM jb"
COUNTS = f"WITH RECURSIVE {sql.BARS}, {PREPARED_CTE}, {JUDGED_CTE} SELECT setup, count(*) FILTER (reasons = '') AS kept, count(*) FILTER (reasons <> '') AS rejected FROM jb GROUP BY 1"
AUDIT = f"WITH RECURSIVE {sql.BARS}, {PREPARED_CTE}, {IDEAS_CTE} SELECT instrument, i, setup, direction, CASE i % 5 WHEN 0 THEN 'bar_missing' WHEN 1 THEN 'entry_differs' WHEN 2 THEN 'stop_differs' ELSE 'confirmed' END AS audit FROM ix"

_NY, _CH = sql.LOCAL.format(ts="ts"), "timezone('America/Chicago', timezone('UTC', ts))"
_UTC = "timezone('UTC', timezone('{z}', CAST({d} AS TIMESTAMP) + INTERVAL {m} MINUTE))"
FLAGS_OF_SESSIONS = f"""WITH {sql.BARS}, a AS (SELECT *, {sql.SESSION} AS session, {_NY} AS ny, {_CH} AS ch, hour({_NY}) * 60 + minute({_NY}) AS m, hour({_CH}) * 60 + minute({_CH}) AS cm FROM bars),
b AS (SELECT *, NOT (isodow(ch) = 6 OR (isodow(ch) = 5 AND cm >= 960) OR (isodow(ch) = 7 AND cm < 1020) OR (cm >= 960 AND cm < 1020)) AS open_ FROM a)
SELECT instrument, i, {_UTC.format(z="America/New_York", d="(session - 1)", m=1080)} AS session_start, {_UTC.format(z="America/New_York", d="session", m=1080)} AS session_end, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01') AS floor_4h,
    CASE WHEN open_ AND isodow(ny) <= 5 AND m >= 570 AND m < 960 THEN epoch({_UTC.format(z="America/New_York", d="CAST(ny AS DATE)", m=960)} - ts) / 60 END AS to_rth_close,
    epoch({_UTC.format(z="America/Chicago", d="(CAST(ch AS DATE) + CASE WHEN cm >= 960 THEN 1 ELSE 0 END)", m=960)} - ts) / 60 AS to_maintenance,
    open_ AND isodow(ny) <= 5 AND m BETWEEN 570 AND 959 AS liquid, open_ AND cm BETWEEN 1020 AND 1079 AS first_hour, m BETWEEN 720 AND 839 AS thin, m < 570 OR m >= 1080 AS overnight, m - 570 AS from_rth_open FROM b"""

TRADING_DAYS = """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), span AS (SELECT CAST(unnest(generate_series(min(day) - 1, max(day) + 8, INTERVAL 1 DAY)) AS DATE) AS x FROM d),
y AS (SELECT DISTINCT year(x) AS y FROM span), g AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), g1 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM g), g2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM g1),
e AS (SELECT y, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS n FROM g2), good AS (SELECT make_date(y, n // 31, n % 31 + 1) - 2 AS friday FROM e),
s AS (SELECT x, month(x) AS m, day(x) AS dd, isodow(x) AS w, (day(x) + 6) // 7 AS nth, day(x) > day(last_day(x)) - 7 AS last_ FROM span),
f AS (SELECT *, w <= 5 AND NOT (m = 1 AND (dd = 1 OR (dd = 2 AND w = 1))) AND NOT (m = 12 AND (dd = 25 OR (dd = 26 AND w = 1))) AND x NOT IN (SELECT friday FROM good) AS trading,
    (w = 1 AND ((m IN (1, 2) AND nth = 3) OR (m = 5 AND last_) OR (m = 9 AND nth = 1))) OR (m = 11 AND w = 4 AND nth = 4) OR (m = 7 AND (dd = 4 OR (dd = 5 AND w = 1))) OR (year(x) >= 2022 AND m = 6 AND (dd = 19 OR (dd = 20 AND w = 1))) OR (m = 12 AND dd = 24)
        OR (m = 11 AND w = 5 AND (day(x - 1) + 6) // 7 = 4 AND month(x - 1) = 11) AS soon FROM s)
SELECT d.day, f.trading, f.trading AND f.soon AS early, (SELECT min(x) FROM f n WHERE n.x >= d.day AND n.trading) AS next_day FROM d JOIN f ON f.x = d.day"""

_LINE = """fl AS (SELECT d.instrument, d.pattern, d.first_i, d.i, d.available, d.price, d.neck, d.break_i, list(b.close ORDER BY b.i) AS c FROM dbl d JOIN bars b ON b.instrument = d.instrument AND b.i BETWEEN d.first_i AND d.i GROUP BY ALL),
fw AS (SELECT *, greatest(3, CAST(floor(len(c) * 0.12) AS BIGINT)) AS w FROM fl),
fs AS (SELECT *, CASE WHEN len(c) - w + 1 >= 5 THEN list_transform(range(1, len(c) - w + 2), lambda k: list_avg(c[k:k + w - 1])) END AS s FROM fw),
fu AS (SELECT * EXCLUDE (c, w, s), s, len(s) AS n, list_min(s) AS lo, list_max(s) AS hi FROM fs),
fp AS (SELECT instrument, pattern, i, first_i, j, CASE WHEN pattern = 'double_bottom' THEN y ELSE 1 - y END AS y FROM (SELECT *, (s[f + 1] + (ax - f) * (s[least(f + 2, n)] - s[f + 1]) - lo) / (hi - lo) AS y FROM (SELECT *, CAST(floor(ax) AS BIGINT) AS f FROM (SELECT *, j * (n - 1) / 100 AS ax FROM (SELECT *, unnest(range(0, 101)) AS j FROM fu WHERE hi > lo))))),
fe AS (SELECT instrument, pattern, i, first_i, p, round(sqrt(avg(power(y - CASE WHEN j / 100 <= p THEN j / 100 / p ELSE (1 - j / 100) / (1 - p) END, 2))), 9) AS e FROM fp CROSS JOIN (SELECT unnest(range(10, 91, 2)) / 100 AS p) GROUP BY 1, 2, 3, 4, 5),
fm AS (SELECT instrument, pattern, i, first_i, min(e) AS form_error, arg_min(p, row(e, p)) AS peak FROM fe GROUP BY 1, 2, 3, 4),
wf AS (SELECT fl.* EXCLUDE c, form_error, peak FROM fl LEFT JOIN fm USING (instrument, pattern, i, first_i))"""
FORMS = f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS}, {DOUBLES_CTE}, {_LINE} SELECT * REPLACE (round(form_error, 6) AS form_error) FROM wf"
BEST = f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS}, {DOUBLES_CTE}, {_LINE} SELECT instrument, pattern, first_i, arg_min(i, row(form_error, i)) AS i, round(min(form_error), 6) AS form_error FROM wf WHERE form_error IS NOT NULL GROUP BY 1, 2, 3"

STEPS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS}, {DOUBLES_CTE},
c AS (SELECT d.*, b.i - d.available AS n, b.high, b.low FROM dbl d JOIN bars b ON b.instrument = d.instrument AND b.i BETWEEN d.available + 1 AND d.available + 120),
g AS (SELECT instrument, pattern, i, min(n) FILTER (CASE WHEN pattern = 'double_bottom' THEN low < price ELSE high > price END) AS invalid_at FROM c GROUP BY 1, 2, 3),
k AS (SELECT CAST(unnest([0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS step),
h AS (SELECT instrument, pattern, i, step, min(n) FILTER (CASE WHEN pattern = 'double_bottom' THEN high >= price + step * (neck - price) ELSE low <= price + step * (neck - price) END) AS hit FROM c CROSS JOIN k GROUP BY 1, 2, 3, 4)
SELECT d.instrument, d.pattern, d.i AS swing_i, k.step, CASE WHEN invalid_at IS NULL OR hit < invalid_at THEN hit END AS reached_at, invalid_at FROM dbl d CROSS JOIN k LEFT JOIN g USING (instrument, pattern, i) LEFT JOIN h ON h.instrument = d.instrument AND h.pattern = d.pattern AND h.i = d.i AND h.step = k.step"""


def _state(minutes: int) -> str:
    base = sql.BARS.replace("raw AS", "raw0 AS").replace("FROM raw)", f"FROM (SELECT instrument, time_bucket(INTERVAL {minutes} MINUTE, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01') + INTERVAL {minutes} MINUTE AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM raw0 WHERE raw0.ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY instrument, time_bucket(INTERVAL {minutes} MINUTE, raw0.ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01')))")
    return f"""(WITH RECURSIVE {base}, {sql.ATR}, {RSI}, {LAST} SELECT ls.instrument, CAST({minutes} AS BIGINT) AS minutes, ls.ts, ls.i + 1 AS bars, ls.close, round(atr.y, 6) AS atr, round(rsi, 6) AS rsi, trend, high_price AS swing_high, low_price AS swing_low
    FROM ls JOIN atr USING (instrument, i) JOIN rsi USING (instrument, i) QUALIFY row_number() OVER (PARTITION BY ls.instrument ORDER BY ls.i DESC) = 1)"""


_FOLLOW = f"""{PREPARED_CTE}, en AS ({_entries(_ENTRIES)}), se AS (SELECT instrument, max(i) AS last, CAST(floor((max(i) + 1) * 0.7) AS BIGINT) AS cut FROM bars GROUP BY 1),
fo AS (SELECT e.instrument, e.i, e.strategy, e.direction, e.stop, e.target, cut, arg_min(b.open, b.i) AS entry, arg_max(b.close, b.i) AS fin, min(b.i) FILTER (CASE WHEN e.direction = 1 THEN b.low <= e.stop ELSE b.high >= e.stop END) AS s, min(b.i) FILTER (CASE WHEN e.direction = 1 THEN b.high >= e.target ELSE b.low <= e.target END) AS g
    FROM en e JOIN se USING (instrument) JOIN bars b ON b.instrument = e.instrument AND b.i BETWEEN e.i + 1 AND e.i + 20 WHERE e.i + 20 <= last GROUP BY ALL),
fp AS (SELECT strategy, i < cut AS inside, 2.0 * direction * (CASE WHEN s IS NOT NULL AND (g IS NULL OR s <= g) THEN stop WHEN g IS NOT NULL THEN target ELSE fin END - entry) - 1.9 - 1.0 AS net FROM fo),
fq AS (SELECT strategy, count(*) FILTER (inside) AS n_train, count(*) FILTER (NOT inside) AS n_oos, coalesce(sum(net) FILTER (inside), 0) AS net_train, coalesce(sum(net) FILTER (NOT inside), 0) AS net_oos, avg(net) FILTER (inside) AS mean, stddev_samp(net) FILTER (inside) AS sd,
    avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) FILTER (inside) AS won_train, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) FILTER (NOT inside) AS won_oos FROM fp GROUP BY 1),
fr AS (SELECT *, CASE WHEN n_train >= 30 AND sd > 0 THEN mean / (sd / sqrt(n_train)) END AS t FROM fq)"""
VERDICTS = f"""WITH RECURSIVE {sql.BARS}, {_FOLLOW} SELECT strategy, n_train, n_oos, round(net_train, 6) AS net_train, round(net_oos, 6) AS net_oos, round(won_train, 6) AS won_train, round(won_oos, 6) AS won_oos, round(t, 6) AS t,
    CASE WHEN t IS NULL THEN 'undecided' WHEN abs(t) > 1.959963984540054 AND net_train > 0 THEN 'candidate' ELSE 'rejected' END AS verdict FROM fr"""

QUERIES = {
    "research_verdicts": research_verdicts,
    "double_forms": lambda s, d: _rounded(sh.with_form(hourly(s, d)), "form_error"),
    "best_forms": lambda s, d: _rounded(sh.best_of_first(sh.with_form(hourly(s, d))), "form_error"),
    "confirmation_steps": lambda s, d: sh.confirmation_steps(hourly(s, d)),
    "market_state": lambda s, d: _rounded(sh.market_state(hourly(s, d), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")), "atr", "rsi"),
    "all_patterns": all_patterns,
    "swing_breaks": lambda s, d: pt.swing_breaks(hourly(s, d)),
    "strategy_entries": strategy_entries,
    "stop_variants": stop_variants,
    "judged_ideas": judged_ideas,
    "idea_counts": idea_counts,
    "idea_audit": idea_audit,
    "session_flags": session_flags,
    "trading_days": trading_days,
}
ORACLES = {
    "research_verdicts": VERDICTS,
    "double_forms": FORMS,
    "best_forms": BEST,
    "confirmation_steps": STEPS,
    "market_state": " UNION ALL ".join(_state(m) for m in (60, 120, 240)),
    "all_patterns": PATTERNS,
    "swing_breaks": BREAKS_OF_SWINGS,
    "strategy_entries": ENTRIES,
    "stop_variants": VARIANTS,
    "judged_ideas": JUDGED,
    "idea_counts": COUNTS,
    "idea_audit": AUDIT,
    "session_flags": FLAGS_OF_SESSIONS,
    "trading_days": TRADING_DAYS,
}
