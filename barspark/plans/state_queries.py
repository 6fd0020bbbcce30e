"""The state of each instrument at a moment, as a flat vector, with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import contracts
from barspark.operators import state as ms
from barspark.plans import sql
from barspark.plans.indicator_queries import ADX_CTES
from barspark.plans.strategy_queries import RSI
from barspark.plans.structure_queries import BREAKS_CTE, DISP_CTE, LAST, LEVELS_CTE, SWEEPS_CTE, SWINGS
from barspark.sources.bars import ticks, ticks_to_bars

AT = "2024-01-19 15:37:00"


def market_vector(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    states = ms.market_state(ticks_to_bars(rows, "1 minute"), rows, F.lit(AT).cast("timestamp_ntz"))
    return ms.feature_vector(states).withColumn("value", F.round("value", 6))


_T = f"TIMESTAMP '{AT}'"
_LOCAL_LESS = sql.LOCAL.format(ts="ts - INTERVAL 1 MICROSECOND")
_OHLCV = "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume"
_ONE = sql.BARS.replace("raw AS", "one AS", 1).split("bars AS")[0].replace("INTERVAL 1 HOUR", "INTERVAL 1 MINUTE").rstrip().rstrip(",")
_FRAME = "SELECT instrument || '|{n}' AS instrument, CAST(e AS TIMESTAMP) AS ts, {o} FROM (SELECT *, {e} AS e FROM seen) GROUP BY instrument, e"
_ENDS = {n: f"time_bucket(INTERVAL {m} MINUTE, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01') + INTERVAL {m} MINUTE" for n, m in ms.FRAMES.items() if m <= 60}
_ENDS["4h"] = f"timezone('UTC', timezone('America/New_York', time_bucket(INTERVAL 4 HOUR, {_LOCAL_LESS}, TIMESTAMP '2024-01-01 02:00:00') + INTERVAL 4 HOUR))"
_ENDS["1d"] = f"timezone('UTC', timezone('America/New_York', CAST(CAST({_LOCAL_LESS} + INTERVAL 6 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 17 HOUR))"
_BARS = f"{_ONE}, seen AS (SELECT * FROM one WHERE one.ts <= {_T}), allf AS ({' UNION ALL '.join(_FRAME.format(n=n, e=e, o=_OHLCV) for n, e in _ENDS.items())}), bars AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS i FROM allf)"
_TICKS = sql.TICKS.replace("event_type AS instrument", "event_type || '|5m' AS instrument").replace("FROM events", f"FROM events WHERE events.ts <= {_T}")
_SWINGS2 = SWINGS.replace("sw0", "sw2").replace("swings AS", "swings2 AS").replace("3 PRECEDING", "2 PRECEDING").replace("3 FOLLOWING", "2 FOLLOWING").replace("nl = 3 AND nr = 3", "nl = 2 AND nr = 2").replace("i + 3", "i + 2")
_NAMED = {
    "price": "price", "is_rth": f"CASE WHEN hour({sql.LOCAL.format(ts=_T)}) * 60 + minute({sql.LOCAL.format(ts=_T)}) BETWEEN 570 AND 959 THEN 1 ELSE 0 END", "minutes_into_session": f"(hour({sql.LOCAL.format(ts=_T)}) * 60 + minute({sql.LOCAL.format(ts=_T)}) + 360) % 1440",
    "ib_complete": "CASE WHEN ib_high IS NOT NULL THEN 1 ELSE 0 END", "or5_break": "CASE WHEN price > or5_high THEN 1 WHEN price < or5_low THEN -1 ELSE 0 END", "or15_break": "CASE WHEN price > or15_high THEN 1 WHEN price < or15_low THEN -1 ELSE 0 END",
    "vola_high": "CASE WHEN a > 10 THEN 1 ELSE 0 END", "vola_low": "CASE WHEN a < 3 THEN 1 ELSE 0 END", "expanding": "CASE WHEN moved THEN 1 ELSE 0 END",
} | {n: f"coalesce({n} - price, 0)" for n in ms.DISTANCES} | {f"{n}_atr": f"coalesce(({n} - price) / CASE WHEN a > 0 THEN a END, 0)" for n in ms.DISTANCES} | {
    "equal_highs": "coalesce(eh, 0)", "equal_lows": "coalesce(el, 0)", "nearest_equal_high": "coalesce(nh - price, 0)", "nearest_equal_low": "coalesce(nl - price, 0)", "swept_high": "coalesce(sh, 0)", "swept_low": "coalesce(sl, 0)",
}
_OWN = {
    "uptrend": "CASE WHEN trend = 1 THEN 1 ELSE 0 END", "downtrend": "CASE WHEN trend = -1 THEN 1 ELSE 0 END", "above_sma50": "CASE WHEN above THEN 1 ELSE 0 END", "above_vwap": "CASE WHEN close > vwap THEN 1 ELSE 0 END", "gaps": "coalesce(gaps, 0)",
    "displacement": "CASE WHEN last - mi <= 3 THEN 1 ELSE 0 END", "break": "CASE WHEN last - bi <= 3 THEN 1 ELSE 0 END", "rsi": "coalesce(rsi, 50)", "adx": "coalesce(x, 0)",
}
_LIST = lambda names: ", ".join(f"{{'n': '{n}', 'v': CAST({e} AS DOUBLE)}}" for n, e in names.items())
VECTOR = f"""WITH RECURSIVE {_BARS}, {ADX_CTES}, {RSI}, {LAST}, {BREAKS_CTE}, {DISP_CTE}, {_TICKS}, {LEVELS_CTE}, {SWEEPS_CTE}, {_SWINGS2},
vw AS (SELECT b.*, {sql.SESSION} AS session FROM bars b), vv AS (SELECT instrument, i, coalesce(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), (high + low + close) / 3) AS vwap FROM vw WINDOW w AS (PARTITION BY instrument, session ORDER BY i)),
ab AS (SELECT instrument, i, close > CASE WHEN i >= 49 THEN avg(close) OVER (PARTITION BY instrument ORDER BY i ROWS 49 PRECEDING) END AS above FROM bars),
q0 AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, min(low) OVER n AS la, max(high) OVER n AS ha FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i), n AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
q1 AS (SELECT instrument, count(*) FILTER (CASE WHEN low - h2 >= 0.25 THEN coalesce(la > (low + h2) / 2, true) ELSE coalesce(ha < (high + l2) / 2, true) END) AS gaps FROM q0 WHERE low - h2 >= 0.25 OR l2 - high >= 0.25 GROUP BY 1),
mv AS (SELECT instrument, max(i) AS mi FROM disp GROUP BY 1), bk AS (SELECT instrument, max(i) AS bi FROM brk GROUP BY 1),
z AS (SELECT b.instrument, b.i AS last, b.close, atr.y AS a, rsi, adx.y AS x, trend, above, vwap, gaps, mi, bi FROM bars b JOIN ls USING (instrument, i) JOIN atr USING (instrument, i) LEFT JOIN rsi USING (instrument, i) LEFT JOIN adx USING (instrument, i) JOIN ab USING (instrument, i) JOIN vv USING (instrument, i)
    LEFT JOIN q1 USING (instrument) LEFT JOIN mv USING (instrument) LEFT JOIN bk USING (instrument) QUALIFY row_number() OVER (PARTITION BY b.instrument ORDER BY b.i DESC) = 1),
l5 AS (SELECT b.instrument, max(b.i) AS last, greatest(1.0, 0.2 * CASE WHEN arg_max(atr.y, b.i) > 0 THEN arg_max(atr.y, b.i) ELSE 0 END) AS tol FROM bars b JOIN atr USING (instrument, i) WHERE b.instrument LIKE '%|5m' GROUP BY 1),
s5 AS (SELECT s.instrument, kind, i, price, last, tol, row_number() OVER (PARTITION BY s.instrument, kind ORDER BY i) AS q FROM swings2 s JOIN l5 USING (instrument)),
r5 AS (SELECT instrument, kind, q, i, price, 1 AS cluster, [{{'s': price, 'c': 1}}] AS cl FROM s5 WHERE q = 1
    UNION ALL SELECT instrument, kind, q, i, price, coalesce(hit, len(cl) + 1), CASE WHEN hit IS NULL THEN list_append(cl, {{'s': price, 'c': 1}}) ELSE list_transform(cl, lambda x, n: CASE WHEN n = hit THEN {{'s': x.s + price, 'c': x.c + 1}} ELSE x END) END
    FROM (SELECT s5.*, r5.cl, nullif(coalesce(list_position(list_transform(r5.cl, lambda x: abs(s5.price - x.s / x.c) <= s5.tol), true), 0), 0) AS hit FROM r5 JOIN s5 ON s5.instrument = r5.instrument AND s5.kind = r5.kind AND s5.q = r5.q + 1)),
e5 AS (SELECT instrument, kind, cluster, avg(price) AS level, least(max(i) + 2, any_value(last)) AS available FROM r5 JOIN l5 USING (instrument) GROUP BY ALL HAVING count(*) > 1),
o5 AS (SELECT e5.* FROM e5 WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.instrument = e5.instrument AND b.i >= available AND CASE WHEN kind = 'high' THEN b.high > level ELSE b.low < level END)),
pr AS (SELECT split_part(instrument, '|', 1) AS name, close AS price FROM z WHERE instrument LIKE '%|1m'),
eq5 AS (SELECT instrument, count(*) FILTER (kind = 'high') AS eh, count(*) FILTER (kind = 'low') AS el, arg_min(level, abs(level - price)) FILTER (kind = 'high') AS nh, arg_min(level, abs(level - price)) FILTER (kind = 'low') AS nl FROM o5 JOIN pr ON pr.name = split_part(instrument, '|', 1) GROUP BY 1),
sw5 AS (SELECT instrument, max(CASE WHEN direction = -1 THEN 1 ELSE 0 END) AS sh, max(CASE WHEN direction = 1 THEN 1 ELSE 0 END) AS sl FROM swp JOIN bars b USING (instrument, i) WHERE name IN ('pdh', 'pdl', 'onh', 'onl') AND {_T} - b.ts <= INTERVAL 60 MINUTE GROUP BY 1),
lx AS (SELECT * FROM lw WHERE instrument LIKE '%|5m' QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY i DESC) = 1),
cx AS (SELECT pr.name, price, lx.* EXCLUDE (instrument), eh, el, nh, nl, sh, sl, coalesce(z5.last >= 2 AND z5.last - z5.mi <= 3, false) AS moved FROM pr JOIN lx ON lx.instrument = pr.name || '|5m' LEFT JOIN eq5 ON eq5.instrument = lx.instrument LEFT JOIN sw5 ON sw5.instrument = lx.instrument LEFT JOIN z z5 ON z5.instrument = lx.instrument),
un AS (SELECT name AS instrument, '' AS pre, unnest([{_LIST(_NAMED)}]) AS e FROM cx UNION ALL SELECT split_part(instrument, '|', 1), split_part(instrument, '|', 2) || '_', unnest([{_LIST(_OWN)}]) FROM z WHERE last >= 2)
SELECT instrument, pre || e.n AS name, round(e.v, 6) AS value FROM un"""


def front_contract(spark, sf_dir):
    """Hourly bars of the front contract of overlapping files: a trader's ticks go to one of five contracts, by day and trader."""
    rows = ticks(spark, sf_dir).withColumn("k", F.floor((F.dayofmonth("ts") + F.col("user_id") % 5) / 8))
    label = [F.col("instrument").alias("root"), (2024 + F.floor(F.col("k") / 4)).cast("int").alias("year"), (F.col("k") % 4 * 3 + 3).cast("int").alias("month")]
    days = rows.groupBy(*label, F.to_date("ts").alias("day")).agg((F.count("*") * 20).alias("n_bytes"))
    bars = ticks_to_bars(rows.withColumn("instrument", F.concat_ws("|", "instrument", F.col("k").cast("string"))), "1 hour")
    part = F.split("instrument", r"\|")
    bars = bars.withColumn("k", part[1].cast("long")).withColumn("instrument", part[0]).select(*label, "ts", "close", "volume")
    return contracts.near_seam(contracts.front_bars(bars, contracts.front_spans(days)), 5)


FRONT = """WITH x AS (SELECT event_type AS root, ts, event_id, value, (day(ts) + user_id % 5) // 8 AS k FROM events),
y AS (SELECT *, CAST(2024 + k // 4 AS INTEGER) AS year, CAST(k % 4 * 3 + 3 AS INTEGER) AS month FROM x),
d AS (SELECT root, year, month, CAST(ts AS DATE) AS day FROM y GROUP BY ALL HAVING count(*) * 20 > 40),
f AS (SELECT root, year, month, min(day) AS start FROM d GROUP BY ALL),
s AS (SELECT *, min(start) OVER (PARTITION BY root ORDER BY year, month ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM f),
b AS (SELECT root, year, month, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS t, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM y GROUP BY ALL),
o AS (SELECT b.root, b.year, b.month, t AS ts, close, volume FROM b JOIN s USING (root, year, month) WHERE CAST(t AS DATE) >= start AND (until IS NULL OR CAST(t AS DATE) < until)),
e AS (SELECT *, coalesce(year * 100 + month <> lag(year * 100 + month) OVER (PARTITION BY root ORDER BY ts), false) AS seam FROM o)
SELECT *, max(seam) OVER (PARTITION BY root ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near_seam FROM e"""

QUERIES = {"market_vector": market_vector, "front_contract": front_contract}
ORACLES = {"market_vector": VECTOR, "front_contract": FRONT}
