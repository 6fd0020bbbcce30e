"""Resampling, session, quality and as-of queries, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import sessions as se
from barspark.operators import levels as lv
from barspark.plans import sql
from barspark.plans.structure_queries import LAST, LEVELS_CTE
from barspark.sources.bars import hourly, ticks, ticks_to_bars


def _rounded(rows, *columns):
    for c in columns:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


def session_context(spark, sf_dir):
    ts = F.col("ts")
    return hourly(spark, sf_dir).select("instrument", "i", se.session_date(ts).alias("session"), se.market_state(ts).alias("state"), se.primary_session(ts).alias("primary_session"), se.is_rth(ts).alias("rth"), se.minutes_to_rth_open(ts).alias("to_rth_open"))


def bar_validation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bars = rows.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"),
        F.when(F.col("l_linenumber") == 7, " ").otherwise(F.col("l_returnflag")).alias("instrument"),
        F.when(F.col("l_partkey") % 50 == 0, "2h").otherwise("1d").alias("timeframe"),
        F.when(F.col("l_suppkey") % 97 == 0, None).otherwise(F.col("l_shipdate")).alias("ts"),
        F.col("l_quantity").alias("open"), (F.col("l_quantity") + 100 * F.col("l_discount") - 1).alias("high"),
        (F.col("l_quantity") - 100 * F.col("l_tax") + 1).alias("low"), (F.col("l_quantity") + 0.5).alias("close"),
        (F.col("l_extendedprice") - 2000).alias("volume"),
    )
    checked = lv.validated(bars, F.lit("1998-01-01").cast("timestamp_ntz"))
    return checked.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def _sources(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    return tuple(ticks_to_bars(rows.filter(F.col("user_id") % 2 == k), "1 hour") for k in (0, 1))


def opening_range_columns(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return lv.with_opening_range(rows, lv.opening_range(ticks(spark, sf_dir), 60)).select("instrument", "i", "or_high", "or_low")


def price_as_of(spark, sf_dir):
    rows = ticks(spark, sf_dir).withColumn("g", F.lit(1))
    left = rows.filter("instrument = 'click'").select("g", "ts", "event_id", "price")
    right = rows.filter("instrument = 'purchase'").select("g", "ts", "event_id", F.col("price").alias("other_price"))
    return lv.as_of(left, right, ["other_price"], ["g"], "event_id").select("event_id", "ts", "price", "other_price")


def newest_upsert(spark, sf_dir):
    rows = ticks(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    split = F.to_timestamp_ntz(F.lit("2024-01-15"))
    out = lv.upserted(rows.filter(F.col("ts") < split), rows.filter(F.col("ts") >= split), ["instrument", "user_id"], "at")
    return out.select("instrument", "user_id", "event_id", "ts", "price")


def inventory(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.col("l_returnflag").alias("instrument")).agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("sources"))


SRC = """src AS (SELECT event_type AS instrument, user_id % 2 AS side, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close
    FROM events e GROUP BY event_type, user_id % 2, time_bucket(INTERVAL 1 HOUR, e.ts))"""

OHLCV = "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume"

LOCAL_LESS = "timezone('America/New_York', timezone('UTC', ts - INTERVAL 1 MICROSECOND))"

STATE = """CASE WHEN isodow({c}) = 6 OR (isodow({c}) = 5 AND {m} >= 960) OR (isodow({c}) = 7 AND {m} < 1020) THEN 'weekend' WHEN {m} >= 960 AND {m} < 1020 THEN 'maintenance' ELSE 'open' END"""


def _tz(zone: str, ts: str = "ts") -> str:
    return f"timezone('{zone}', timezone('UTC', {ts}))"


CONTEXT = f"""WITH {sql.BARS},
l AS (SELECT *, {_tz("America/New_York")} AS ny, {_tz("America/Chicago")} AS ch, {_tz("Asia/Tokyo")} AS tk, {_tz("Europe/London")} AS ld FROM bars),
m AS (SELECT *, hour(ny) * 60 + minute(ny) AS nm, hour(ch) * 60 + minute(ch) AS cm, hour(tk) * 60 + minute(tk) AS tm, hour(ld) * 60 + minute(ld) AS lm FROM l),
d AS (SELECT *, CAST(ny AS DATE) + CASE WHEN nm > 570 THEN 1 ELSE 0 END AS d0 FROM m),
f AS (SELECT *, d0 + CASE isodow(d0) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS d1 FROM d)
SELECT instrument, i, {sql.SESSION} AS session, {STATE.format(c="ch", m="cm")} AS state,
    CASE WHEN nm >= 570 AND nm < 1020 THEN 'new_york' WHEN lm >= 480 AND lm < 990 THEN 'london' WHEN tm >= 540 AND tm < 1080 THEN 'asia' END AS primary_session,
    isodow(ny) <= 5 AND nm >= 570 AND nm < 960 AS rth,
    CAST(floor(epoch(timezone('UTC', timezone('America/New_York', CAST(d1 AS TIMESTAMP) + INTERVAL 570 MINUTE)) - ts) / 60) AS BIGINT) AS to_rth_open FROM f"""

LEVELS = f"""WITH {sql.TICKS},
a AS (SELECT instrument, session, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close,
    max(price) FILTER (m < 570 OR m >= 1080) AS overnight_high, min(price) FILTER (m < 570 OR m >= 1080) AS overnight_low,
    max(price) FILTER (m BETWEEN 570 AND 959) AS rth_high, min(price) FILTER (m BETWEEN 570 AND 959) AS rth_low,
    arg_min(price, row(ts, event_id)) FILTER (m BETWEEN 570 AND 959) AS cash_open, arg_max(price, row(ts, event_id)) FILTER (m BETWEEN 570 AND 959) AS cash_close FROM t GROUP BY 1, 2),
b AS (SELECT *, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low, lag(close) OVER w AS prev_close, lag(cash_close) OVER w AS prev_cash_close FROM a WINDOW w AS (PARTITION BY instrument ORDER BY session))
SELECT * REPLACE (round(gap, 6) AS gap), CASE WHEN gap > 0 THEN rth_low <= prev_cash_close WHEN gap < 0 THEN rth_high >= prev_cash_close WHEN gap = 0 THEN true END AS gap_filled FROM (SELECT *, cash_open - prev_cash_close AS gap FROM b)"""

VALIDATION = """WITH b AS (SELECT CASE WHEN l_linenumber = 7 THEN ' ' ELSE l_returnflag END AS instrument, CASE WHEN l_partkey % 50 = 0 THEN '2h' ELSE '1d' END AS timeframe,
    CASE WHEN l_suppkey % 97 = 0 THEN NULL ELSE l_shipdate END AS ts, l_quantity AS o, l_quantity + 100 * l_discount - 1 AS h, l_quantity - 100 * l_tax + 1 AS l, l_quantity + 0.5 AS c, l_extendedprice - 2000 AS v FROM lineitem)
SELECT CASE WHEN trim(instrument) = '' THEN 'instrument_missing' WHEN timeframe = '2h' THEN 'timeframe_unknown' WHEN ts IS NULL THEN 'time_unreadable' WHEN ts > TIMESTAMP '1998-01-01 00:05:00' THEN 'time_in_future'
    WHEN v < 0 THEN 'volume_bad' WHEN h < l THEN 'high_under_low' WHEN greatest(o, c) > h OR least(o, c) < l THEN 'prices_inconsistent' ELSE 'accepted' END AS reason, count(*) AS n FROM b GROUP BY 1"""

PROFILE = f"""WITH {sql.BARS}, p AS (SELECT *, {sql.SESSION} AS session, CAST(floor(low / 10.0) AS BIGINT) AS a, CAST(floor(high / 10.0) AS BIGINT) AS z FROM bars),
x AS (SELECT instrument, session, volume / (z - a + 1) AS v, unnest(range(a, z + 1)) AS bin FROM p)
SELECT instrument, session, bin, round(sum(v), 6) AS volume FROM x GROUP BY ALL"""

VALUE_AREA = f"""WITH RECURSIVE {sql.BARS}, p AS (SELECT *, {sql.SESSION} AS session, CAST(floor(low / 10.0) AS BIGINT) AS a, CAST(floor(high / 10.0) AS BIGINT) AS z FROM bars),
x AS (SELECT instrument, session, volume / (z - a + 1) AS v, unnest(range(a, z + 1)) AS bin FROM p), v AS (SELECT instrument, session, bin, sum(v) AS v FROM x GROUP BY ALL),
g AS (SELECT instrument, session, min(bin) AS lo, max(bin) AS hi, sum(v) AS total FROM v GROUP BY 1, 2), c AS (SELECT instrument, session, bin AS poc, v FROM v QUALIFY row_number() OVER (PARTITION BY instrument, session ORDER BY round(v, 9) DESC, bin) = 1),
r AS (SELECT instrument, session, poc, poc AS a, poc AS b, v AS held, lo, hi, total, 0 AS n FROM c JOIN g USING (instrument, session)
    UNION ALL SELECT instrument, session, poc, CASE WHEN up >= down THEN a ELSE a - 1 END, CASE WHEN up >= down THEN b + 1 ELSE b END, held + greatest(up, down), lo, hi, total, n + 1
    FROM (SELECT r.*, CASE WHEN r.b < hi THEN round(coalesce(u.v, 0), 9) ELSE -1 END AS up, CASE WHEN r.a > lo THEN round(coalesce(d.v, 0), 9) ELSE -1 END AS down FROM r
        LEFT JOIN v u ON u.instrument = r.instrument AND u.session = r.session AND u.bin = r.b + 1 LEFT JOIN v d ON d.instrument = r.instrument AND d.session = r.session AND d.bin = r.a - 1)
    WHERE held < 0.7 * total - 1e-9 AND (a > lo OR b < hi))
SELECT instrument, session, poc, a AS val, b AS vah FROM r QUALIFY row_number() OVER (PARTITION BY instrument, session ORDER BY n DESC) = 1"""

GAPS = f"""WITH {sql.BARS}, g AS (SELECT instrument, ts, lead(ts) OVER (PARTITION BY instrument ORDER BY ts) AS next_ts FROM bars),
x AS (SELECT instrument, ts, next_ts, unnest(generate_series(ts + INTERVAL 1 HOUR, next_ts - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS mt FROM g WHERE next_ts > ts + INTERVAL 1 HOUR),
y AS (SELECT *, {_tz("America/Chicago", "mt")} AS c FROM x), z AS (SELECT *, hour(c) * 60 + minute(c) AS m FROM y),
q AS (SELECT instrument, ts, next_ts, count(*) AS missing, count(*) FILTER ({STATE.format(c="c", m="m")} = 'open') AS missing_open FROM z GROUP BY 1, 2, 3)
SELECT * FROM q WHERE missing_open >= 1"""

ROLLS = f"""WITH {sql.BARS}, r AS (SELECT instrument, i, ts, abs(open - lag(close) OVER w) / nullif(abs(lag(close) OVER w), 0) * 100 AS jump FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY ts)), b AS (SELECT * FROM r WHERE jump > 200)"""

QUERIES = {
    "bars_hourly": hourly,
    "bars_4h_session": lambda s, d: lv.resample_4h(hourly(s, d)),
    "bars_daily_session": lambda s, d: lv.resample_daily(hourly(s, d)),
    "bars_resampled_2h": lambda s, d: lv.resample(hourly(s, d), 120),
    "session_context": session_context,
    "opening_range": opening_range_columns,
    "session_levels": lambda s, d: _rounded(lv.session_levels(ticks(s, d)), "gap"),
    "volume_profile": lambda s, d: _rounded(lv.volume_profile(hourly(s, d), 10.0), "volume"),
    "value_area": lambda s, d: lv.value_area(lv.volume_profile(hourly(s, d), 10.0)),
    "level_columns": lambda s, d: lv.level_columns(hourly(s, d), ticks(s, d)).select("instrument", "i", *lv.LEVEL_NAMES),
    "coarse_to_fine": lambda s, d: lv.coarse_to_fine(lv.resample(b := hourly(s, d), 240), b).select("instrument", "ts", "fine_i"),
    "bar_validation": bar_validation,
    "newest_upsert": newest_upsert,
    "inventory": inventory,
    "gap_check": lambda s, d: lv.gaps(hourly(s, d)),
    "roll_boundaries": lambda s, d: _rounded(lv.roll_boundaries(hourly(s, d), 200.0), "jump"),
    "near_roll": lambda s, d: lv.near_boundary(b := hourly(s, d), lv.roll_boundaries(b, 200.0)).select("instrument", "i", "near_roll"),
    "source_comparison": lambda s, d: _rounded(lv.compared(*_sources(s, d), 5.0), "largest", "within"),
    "price_as_of": price_as_of,
}
ORACLES = {
    "bars_hourly": f"WITH {sql.BARS} SELECT * FROM bars",
    "bars_4h_session": f"WITH {sql.BARS}, x AS (SELECT *, time_bucket(INTERVAL 4 HOUR, {LOCAL_LESS}, TIMESTAMP '2024-01-01 02:00:00') + INTERVAL 4 HOUR AS bucket FROM bars), g AS (SELECT instrument, bucket, {OHLCV} FROM x GROUP BY 1, 2) SELECT * EXCLUDE bucket, timezone('UTC', timezone('America/New_York', bucket)) AS ts FROM g",
    "bars_daily_session": f"WITH {sql.BARS}, x AS (SELECT *, CAST({LOCAL_LESS} + INTERVAL 6 HOUR AS DATE) AS session FROM bars), g AS (SELECT instrument, session, {OHLCV} FROM x GROUP BY 1, 2) SELECT *, timezone('UTC', timezone('America/New_York', CAST(session AS TIMESTAMP) + INTERVAL 17 HOUR)) AS ts FROM g",
    "bars_resampled_2h": f"WITH {sql.BARS}, x AS (SELECT * EXCLUDE i, time_bucket(INTERVAL 2 HOUR, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01') + INTERVAL 2 HOUR AS bucket FROM bars), g AS (SELECT instrument, bucket, {OHLCV} FROM x GROUP BY 1, 2) SELECT instrument, bucket AS ts, open, high, low, close, volume FROM g",
    "session_context": CONTEXT,
    "opening_range": f"WITH {sql.BARS}, {sql.TICKS}, r AS (SELECT instrument, session, max(price) AS top, min(price) AS bottom FROM t WHERE m >= 570 AND m < 630 AND CAST(lts AS DATE) = session GROUP BY 1, 2), x AS (SELECT *, {sql.SESSION} AS session FROM bars) SELECT instrument, i, CASE WHEN ts >= k THEN top END AS or_high, CASE WHEN ts >= k THEN bottom END AS or_low FROM (SELECT x.*, top, bottom, timezone('UTC', timezone('America/New_York', CAST(session AS TIMESTAMP) + INTERVAL 630 MINUTE)) AS k FROM x LEFT JOIN r USING (instrument, session))",
    "session_levels": LEVELS,
    "volume_profile": PROFILE,
    "bar_validation": VALIDATION,
    "newest_upsert": "SELECT event_type AS instrument, user_id, event_id, ts, value AS price FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1",
    "inventory": "SELECT l_returnflag AS instrument, count(*) AS n, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS sources FROM lineitem GROUP BY 1",
    "gap_check": GAPS,
    "roll_boundaries": f"{ROLLS} SELECT instrument, i, ts, round(jump, 6) AS jump FROM b",
    "near_roll": f"{ROLLS} SELECT bars.instrument, bars.i, EXISTS (SELECT 1 FROM b WHERE b.instrument = bars.instrument AND abs(b.i - bars.i) <= 5) AS near_roll FROM bars",
    "source_comparison": f"WITH {SRC}, k AS (SELECT CAST(unnest([-1, 0, 1]) AS BIGINT) AS shift), m AS (SELECT a.instrument, shift, greatest(abs(a.open - b.open), abs(a.high - b.high), abs(a.low - b.low), abs(a.close - b.close)) AS d FROM src a CROSS JOIN k JOIN src b ON b.instrument = a.instrument AND b.ts = a.ts + shift * INTERVAL 1 HOUR WHERE a.side = 0 AND b.side = 1) SELECT instrument, shift, count(*) AS n, round(max(d), 6) AS largest, round(avg(CASE WHEN d <= 5 THEN 1.0 ELSE 0.0 END), 6) AS within FROM m GROUP BY 1, 2",
    "price_as_of": "WITH r AS (SELECT ts AS rts, arg_max(value, event_id) AS other_price FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id, ts, value AS price, other_price FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN r ON l.ts >= r.rts",
    "value_area": VALUE_AREA,
    "coarse_to_fine": f"WITH {sql.BARS}, x AS (SELECT DISTINCT instrument, time_bucket(INTERVAL 4 HOUR, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01') + INTERVAL 4 HOUR AS ts FROM bars) SELECT x.instrument, x.ts, bars.i AS fine_i FROM x LEFT JOIN bars ON bars.instrument = x.instrument AND bars.ts = x.ts",
    "level_columns": f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {sql.TICKS}, {LAST}, {LEVELS_CTE} SELECT instrument, i, {', '.join(lv.LEVEL_NAMES)} FROM lw",
}
