"""Structure queries over hourly bars, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import points
from barspark.operators import structure as st
from barspark.operators.levels import LEVEL_NAMES, levels_long
from barspark.plans import sql
from barspark.sources.bars import hourly, ticks


def _rounded(rows, *columns):
    for c in columns:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


def _query(build, *columns):
    return lambda spark, sf_dir: _rounded(build(hourly(spark, sf_dir)), *columns)


def last_swings(spark, sf_dir):
    rows = st.with_last_swings(hourly(spark, sf_dir))
    return rows.select("instrument", "i", "high_price", "high_origin", "high_label", "high_before", "high_before_origin", "low_price", "low_origin", "low_label", "low_before", "low_before_origin", "trend")


SWINGS = """sw0 AS (SELECT *, count(*) OVER l AS nl, count(*) OVER r AS nr, max(high) OVER l AS hl, max(high) OVER r AS hr, min(low) OVER l AS ll, min(low) OVER r AS lr FROM bars
    WINDOW l AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
swings AS (SELECT instrument, 'high' AS kind, i, ts, high AS price, i + 3 AS available FROM sw0 WHERE nl = 3 AND nr = 3 AND high > hl AND high >= hr
    UNION ALL SELECT instrument, 'low', i, ts, low, i + 3 FROM sw0 WHERE nl = 3 AND nr = 3 AND low < ll AND low <= lr)"""

LAST = (
    SWINGS
    + """, lab AS (SELECT *, lag(price) OVER w AS before, lag(i) OVER w AS bo, CASE WHEN lag(price) OVER w IS NULL THEN NULL ELSE (CASE WHEN price > lag(price) OVER w THEN 'H' ELSE 'L' END) || (CASE WHEN kind = 'high' THEN 'H' ELSE 'L' END) END AS label
    FROM swings WINDOW w AS (PARTITION BY instrument, kind ORDER BY i)),
j AS (SELECT b.*, h.price AS hp, h.i AS ho, h.label AS hlb, h.before AS hb, h.bo AS hbo, l.bo AS lbo, l.price AS lp, l.i AS lo, l.label AS llb, l.before AS lb FROM bars b
    LEFT JOIN lab h ON h.kind = 'high' AND h.instrument = b.instrument AND h.available = b.i LEFT JOIN lab l ON l.kind = 'low' AND l.instrument = b.instrument AND l.available = b.i),
f AS (SELECT instrument, i, ts, close, last_value(hp IGNORE NULLS) OVER w AS high_price, last_value(ho IGNORE NULLS) OVER w AS high_origin, last_value(hlb IGNORE NULLS) OVER w AS high_label, last_value(hb IGNORE NULLS) OVER w AS high_before, last_value(hbo IGNORE NULLS) OVER w AS high_before_origin, last_value(lbo IGNORE NULLS) OVER w AS low_before_origin,
    last_value(lp IGNORE NULLS) OVER w AS low_price, last_value(lo IGNORE NULLS) OVER w AS low_origin, last_value(llb IGNORE NULLS) OVER w AS low_label, last_value(lb IGNORE NULLS) OVER w AS low_before
    FROM j WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS UNBOUNDED PRECEDING)),
tr0 AS (SELECT *, CASE WHEN high_label = 'HH' AND low_label = 'HL' THEN 1 WHEN high_label = 'LH' AND low_label = 'LL' THEN -1 END AS flip FROM f),
ls AS (SELECT * EXCLUDE flip, CAST(coalesce(last_value(flip IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS trend FROM tr0)"""
)

BREAKS_CTE = """brp AS (SELECT ls.*, atr.y AS a, coalesce(lag(trend) OVER (PARTITION BY instrument ORDER BY i), 0) AS t FROM ls JOIN atr USING (instrument, i)),
bre AS (SELECT instrument, i, CAST(1 AS BIGINT) AS direction, high_origin AS origin, high_price AS level, t AS trend FROM brp WHERE close > high_price + 0.05 * a
    UNION ALL SELECT instrument, i, -1, low_origin, low_price, t FROM brp WHERE close < low_price - 0.05 * a),
brk AS (SELECT *, CASE WHEN trend * direction >= 0 THEN 'bos' ELSE 'choch' END AS variant FROM bre QUALIFY row_number() OVER (PARTITION BY instrument, direction, origin ORDER BY i) = 1)"""
BREAKS = f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {LAST}, {BREAKS_CTE} SELECT * FROM brk"

FVG_CTE = """g0 AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, list(low) OVER n AS lows, list(high) OVER n AS highs FROM bars
    WINDOW w AS (PARTITION BY instrument ORDER BY i), n AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 240 FOLLOWING)),
fvg AS (SELECT instrument, i, i - 1 AS origin, CAST(CASE WHEN low - h2 >= 0.25 THEN 1 ELSE -1 END AS BIGINT) AS direction, CASE WHEN low - h2 >= 0.25 THEN h2 ELSE high END AS bottom, CASE WHEN low - h2 >= 0.25 THEN low ELSE l2 END AS top, lows, highs
    FROM g0 WHERE low - h2 >= 0.25 OR l2 - high >= 0.25)"""
FVG = f"""WITH {sql.BARS}, {FVG_CTE}
SELECT instrument, i, origin, direction, bottom, top,
    CAST(nullif(coalesce(CASE WHEN direction = 1 THEN list_position(list_transform(lows, lambda x: x <= (top + bottom) / 2), true) ELSE list_position(list_transform(highs, lambda x: x >= (top + bottom) / 2), true) END, 0), 0) AS BIGINT) AS mitigated_after,
    round(CASE WHEN lows IS NOT NULL THEN least(1.0, greatest(0.0, (CASE WHEN direction = 1 THEN top - list_min(lows) ELSE list_max(highs) - bottom END) / (top - bottom))) END, 6) AS fill FROM fvg"""

DISP_CTE = """disp AS (SELECT instrument, i, CAST(CASE WHEN close > open THEN 1 ELSE -1 END AS BIGINT) AS direction, abs(close - open) / (high - low) AS body_ratio, a AS atr
    FROM (SELECT b.*, atr.y AS a, avg(volume) OVER (PARTITION BY instrument ORDER BY i ROWS 19 PRECEDING) AS mv FROM bars b JOIN atr USING (instrument, i))
    WHERE high > low AND abs(close - open) / (high - low) >= 0.6 AND (a IS NULL OR abs(close - open) >= a) AND volume >= mv)"""
DISP = f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {DISP_CTE} SELECT instrument, i, direction, round(body_ratio, 6) AS body_ratio, round(atr, 6) AS atr FROM disp"

BLOCKS_CTE = """obc AS (SELECT d.instrument, d.i, d.direction, b.i AS origin, b.high AS top, b.low AS bottom FROM disp d JOIN bars b ON b.instrument = d.instrument AND b.i BETWEEN d.i - 10 AND d.i - 1
    AND CASE WHEN d.direction = 1 THEN b.close < b.open ELSE b.close > b.open END),
ob AS (SELECT * FROM obc QUALIFY row_number() OVER (PARTITION BY instrument, i ORDER BY origin DESC) = 1)"""
BLOCKS = f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {DISP_CTE}, {BLOCKS_CTE} SELECT * FROM ob"

_SPANS = {"or5": 5, "or15": 15, "or30": 30, "ib": 60}
_INSIDE = {"on": "m < 570 OR m >= 1080"} | {n: f"CAST(lts AS DATE) = session AND m BETWEEN 570 AND {569 + k}" for n, k in _SPANS.items()}


def _level(name: str, side: str) -> str:
    return f"on{side[0]}" if name == "on" else f"{name}_{side}"


_KNOWN = "timezone('UTC', timezone('America/New_York', CAST(session AS TIMESTAMP) + INTERVAL {m} MINUTE))"
_RANGES = ", ".join(f"{f}(price) FILTER ({inside}) AS r_{_level(n, side)}" for n, inside in _INSIDE.items() for side, f in (("high", "max"), ("low", "min")))
_MASKED = ", ".join(f"CASE WHEN ts >= {_KNOWN.format(m=570 + _SPANS.get(n, 0))} THEN r_{_level(n, side)} END AS {_level(n, side)}" for n in _INSIDE for side in ("high", "low"))
#: lw: the bars with all levels known at them; lv: one row a level.
LEVELS_CTE = f"""rg AS (SELECT instrument, session, {_RANGES} FROM t GROUP BY 1, 2),
lb AS (SELECT *, lag(high) OVER w AS ph0, lag(low) OVER w AS pl0, lag(close) OVER w AS pc0, {sql.SESSION} AS session FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i)),
ld AS (SELECT instrument, session, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM lb GROUP BY 1, 2),
lp AS (SELECT instrument, session, lag(h) OVER w AS pdh, lag(l) OVER w AS pdl, lag(c) OVER w AS pdc FROM ld WINDOW w AS (PARTITION BY instrument ORDER BY session)),
lw0 AS (SELECT lb.*, atr.y AS a, pdh, pdl, pdc, rg.* EXCLUDE (instrument, session), high_price AS swing_high, low_price AS swing_low FROM lb JOIN atr USING (instrument, i) LEFT JOIN lp USING (instrument, session) LEFT JOIN rg ON rg.instrument = lb.instrument AND rg.session = lb.session JOIN ls ON ls.instrument = lb.instrument AND ls.i = lb.i),
lw AS (SELECT *, {_MASKED} FROM lw0),
lv0 AS (SELECT instrument, i, high, low, close, ph0, pl0, pc0, a, unnest([{", ".join(f"'{n}'" for n in LEVEL_NAMES)}]) AS name, unnest([{", ".join(LEVEL_NAMES)}]) AS level FROM lw WHERE a > 0 AND i > 0),
lv AS (SELECT * FROM lv0 WHERE level IS NOT NULL)"""

SWEEPS_CTE = """sc AS (SELECT instrument, i, a, name, CAST(-1 AS BIGINT) AS direction, level FROM lv WHERE high > level AND ph0 <= level UNION ALL SELECT instrument, i, a, name, 1, level FROM lv WHERE low < level AND pl0 >= level),
sr AS (SELECT sc.*, b.i AS k FROM sc JOIN bars b ON b.instrument = sc.instrument AND b.i BETWEEN sc.i AND sc.i + 3 AND CASE WHEN direction = -1 THEN b.close < level ELSE b.close > level END
    QUALIFY row_number() OVER (PARTITION BY sc.instrument, sc.i, name, direction ORDER BY b.i) = 1),
sd0 AS (SELECT sr.instrument, sr.i AS origin, sr.k AS i, name, direction, level, a, max(b.high) AS mh, min(b.low) AS ml FROM sr JOIN bars b ON b.instrument = sr.instrument AND b.i BETWEEN sr.i AND sr.k GROUP BY ALL),
sd AS (SELECT * FROM (SELECT *, abs(CASE WHEN direction = -1 THEN mh ELSE ml END - level) AS depth FROM sd0) WHERE depth >= 0.05 * a),
sa AS (SELECT instrument, name, direction, min(origin) AS origin, arg_min(i, origin) AS i FROM sd GROUP BY 1, 2, 3
    UNION ALL SELECT * FROM (SELECT d.instrument, d.name, d.direction, min(d.origin) AS origin, arg_min(d.i, d.origin) AS i FROM sa JOIN sd d ON d.instrument = sa.instrument AND d.name = sa.name AND d.direction = sa.direction AND d.origin > sa.i GROUP BY 1, 2, 3)),
swp AS (SELECT sd.instrument, sd.name, sd.direction, sd.origin, sd.i, level, depth FROM sa JOIN sd USING (instrument, name, direction, origin))"""
SWEEPS = f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {sql.TICKS}, {LAST}, {LEVELS_CTE}, {SWEEPS_CTE} SELECT * REPLACE (round(depth, 6) AS depth) FROM swp"

DOUBLES_CTE = """dpr AS (SELECT *, lag(i) OVER w AS first_i, lag(price) OVER w AS first_price FROM swings WINDOW w AS (PARTITION BY instrument, kind ORDER BY i)),
dq AS (SELECT dpr.*, atr.y AS a FROM dpr JOIN atr ON atr.instrument = dpr.instrument AND atr.i = dpr.available WHERE atr.y > 0 AND dpr.i - first_i <= 120 AND abs(price - first_price) <= 0.5 * atr.y),
dn0 AS (SELECT dq.*, max(o.price) AS mh, min(o.price) AS ml FROM dq JOIN swings o ON o.instrument = dq.instrument AND o.kind <> dq.kind AND o.i > dq.first_i AND o.i < dq.i GROUP BY ALL),
dn1 AS (SELECT *, CASE WHEN kind = 'low' THEN mh ELSE ml END AS neck FROM dn0),
dn AS (SELECT *, abs((price + first_price) / 2 - neck) AS depth FROM dn1 WHERE abs((price + first_price) / 2 - neck) >= a),
dk AS (SELECT dn.instrument, dn.kind, dn.i, min(b.i) AS break_i FROM dn JOIN bars b ON b.instrument = dn.instrument AND b.i BETWEEN dn.available AND dn.available + 24 AND CASE WHEN kind = 'low' THEN b.close > neck ELSE b.close < neck END GROUP BY ALL),
dbl AS (SELECT instrument, CASE WHEN kind = 'low' THEN 'double_bottom' ELSE 'double_top' END AS pattern, first_i, i, available, first_price, price, neck,
    greatest(0.0, least(1.0, 0.4 * (1 - abs(price - first_price) / (0.5 * a)) + 0.6 * greatest(0.0, least(1.0, depth / (2 * a))))) AS confidence, break_i FROM dn LEFT JOIN dk USING (instrument, kind, i))"""
DOUBLES = f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS}, {DOUBLES_CTE} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM dbl"

EQUAL_CTE = """es AS (SELECT s.*, atr.y AS a, row_number() OVER (PARTITION BY s.instrument, kind ORDER BY s.i) AS q FROM swings s JOIN atr ON atr.instrument = s.instrument AND atr.i = s.available),
er AS (SELECT instrument, kind, q, i, available, [i] AS mi, [price] AS mp, false AS hit FROM es WHERE q = 1
    UNION ALL SELECT instrument, kind, q, i, available, CASE WHEN fits THEN list_append(ki, i)[-8:] ELSE [i] END, CASE WHEN fits THEN list_append(kp, price)[-8:] ELSE [price] END, fits
    FROM (SELECT *, coalesce(a > 0 AND len(kp) > 0 AND len(list_filter(kp, lambda p: abs(p - price) > greatest(1.0, 0.2 * a))) = 0, false) AS fits
        FROM (SELECT *, mi[gone + 1:] AS ki, mp[gone + 1:] AS kp FROM (SELECT e.*, r.mi, r.mp, len(list_filter(r.mi, lambda j: e.i - j > 120)) AS gone FROM er r JOIN es e ON e.instrument = r.instrument AND e.kind = r.kind AND e.q = r.q + 1)))),
eq AS (SELECT instrument, kind, mi[1] AS first, i, available, CAST(len(mp) AS BIGINT) AS members, list_avg(mp) AS level FROM er WHERE hit)"""

ZONES = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS},
l AS (SELECT b.instrument, arg_max(close, b.i) AS now, arg_max(atr.y, b.i) AS a, max(b.i) AS last FROM bars b JOIN atr USING (instrument, i) GROUP BY 1),
x AS (SELECT s.*, now, a, last, CASE WHEN a > 0 THEN 0.5 * a ELSE 0.0005 * abs(now) END AS tol, CASE WHEN price < now THEN 'support' ELSE 'resistance' END AS side FROM swings s JOIN l USING (instrument) WHERE price <> now AND i >= last - 116),
y AS (SELECT *, CASE WHEN price - lag(price) OVER w > tol THEN 1 ELSE 0 END AS fresh FROM x WINDOW w AS (PARTITION BY instrument, side ORDER BY price, i, kind)),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument, side ORDER BY price, i, kind ROWS UNBOUNDED PRECEDING) AS zone FROM y),
g AS (SELECT instrument, side, zone, now, a, avg(price) AS price, min(price) AS bottom, max(price) AS top, count(*) AS touches, any_value(last) - max(i) AS bars_since FROM z GROUP BY ALL),
h AS (SELECT *, abs(price - now) AS distance FROM g)
SELECT instrument, side, row_number() OVER w AS rank, round(price, 6) AS price, bottom, top, touches, bars_since, round(distance, 6) AS distance, round(CASE WHEN a > 0 THEN distance / a END, 6) AS distance_atr FROM h WINDOW w AS (PARTITION BY instrument, side ORDER BY distance, bottom) QUALIFY row_number() OVER w <= 3"""

TREND = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR},
m AS (SELECT *, CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY instrument ORDER BY i ROWS 19 PRECEDING) END AS s, CASE WHEN i >= 49 THEN avg(close) OVER (PARTITION BY instrument ORDER BY i ROWS 49 PRECEDING) END AS l FROM bars),
q AS (SELECT m.*, (s - lag(s, 10) OVER (PARTITION BY instrument ORDER BY i)) / 10 AS points, (s - lag(s, 10) OVER (PARTITION BY instrument ORDER BY i)) / 10 / nullif(atr.y, 0) AS slope, close > l AS above FROM m JOIN atr USING (instrument, i))
SELECT instrument, i, round(points, 6) AS slope_points, round(slope, 6) AS slope, above, CASE WHEN slope > 0.02 AND above THEN 'up' WHEN slope < -0.02 AND NOT above THEN 'down' WHEN slope IS NOT NULL AND l IS NOT NULL THEN 'sideways' END AS trend,
    CASE WHEN slope IS NULL OR l IS NULL THEN 'unknown' WHEN abs(slope) <= 0.02 THEN 'flat' WHEN (slope > 0) = above THEN 'agreed' ELSE 'mixed' END AS basis FROM q"""

OPEN_GAPS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR},
g0 AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, min(low) OVER n AS low_after, max(high) OVER n AS high_after FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i), n AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g1 AS (SELECT g0.*, atr.y AS a, CAST(CASE WHEN low - h2 >= 0.25 THEN 1 ELSE -1 END AS BIGINT) AS direction, CASE WHEN low - h2 >= 0.25 THEN h2 ELSE high END AS bottom, CASE WHEN low - h2 >= 0.25 THEN low ELSE l2 END AS top FROM g0 JOIN atr USING (instrument, i) WHERE low - h2 >= 0.25 OR l2 - high >= 0.25),
m AS (SELECT g1.instrument, g1.i, min(b.i) AS mitigated_i FROM g1 JOIN bars b ON b.instrument = g1.instrument AND b.i > g1.i AND CASE WHEN direction = 1 THEN b.low <= (top + bottom) / 2 ELSE b.high >= (top + bottom) / 2 END GROUP BY ALL)
SELECT g1.instrument, g1.i - 1 AS origin, g1.i, direction, bottom, top, round(top - bottom, 6) AS points, round((top - bottom) / CASE WHEN a > 0 THEN a END, 6) AS size_atr, mitigated_i,
    round(coalesce(least(1.0, greatest(0.0, CASE WHEN direction = 1 THEN top - low_after ELSE high_after - bottom END / (top - bottom))), 0.0), 6) AS fill FROM g1 LEFT JOIN m USING (instrument, i)"""

EQUAL_LEVELS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS},
l AS (SELECT b.instrument, max(b.i) AS last, greatest(1.0, 0.2 * CASE WHEN arg_max(atr.y, b.i) > 0 THEN arg_max(atr.y, b.i) ELSE 0 END) AS tol FROM bars b JOIN atr USING (instrument, i) GROUP BY 1),
s AS (SELECT s.instrument, kind, i, price, last, tol, row_number() OVER (PARTITION BY s.instrument, kind ORDER BY i) AS q FROM swings s JOIN l USING (instrument) WHERE i >= last - 116),
r AS (SELECT instrument, kind, q, i, price, 1 AS cluster, [{{'s': price, 'c': 1}}] AS cl FROM s WHERE q = 1
    UNION ALL SELECT instrument, kind, q, i, price, coalesce(hit, len(cl) + 1), CASE WHEN hit IS NULL THEN list_append(cl, {{'s': price, 'c': 1}}) ELSE list_transform(cl, lambda x, n: CASE WHEN n = hit THEN {{'s': x.s + price, 'c': x.c + 1}} ELSE x END) END
    FROM (SELECT s.*, r.cl, nullif(coalesce(list_position(list_transform(r.cl, lambda x: abs(s.price - x.s / x.c) <= s.tol), true), 0), 0) AS hit FROM r JOIN s ON s.instrument = r.instrument AND s.kind = r.kind AND s.q = r.q + 1)),
e AS (SELECT instrument, kind, cluster, count(*) AS members, avg(price) AS level, min(i) AS first, max(i) AS latest FROM r GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT e.*, least(latest + 3, last) AS available, tol AS tolerance FROM e JOIN l USING (instrument)),
w AS (SELECT k.instrument, k.kind, k.cluster, min(b.i) AS swept_i FROM k JOIN bars b ON b.instrument = k.instrument AND b.i >= available AND CASE WHEN kind = 'high' THEN b.high > level ELSE b.low < level END GROUP BY ALL)
SELECT instrument, kind, first, latest, available, members, round(level, 6) AS level, round(tolerance, 6) AS tolerance, swept_i IS NOT NULL AS swept, swept_i FROM k LEFT JOIN w USING (instrument, kind, cluster)"""

BOTTOMS = f"""WITH RECURSIVE {sql.BARS}, {SWINGS}, tl AS (SELECT instrument, i AS low_i, price AS stop, available FROM swings WHERE kind = 'low'),
tb AS (SELECT tl.*, b.i, b.low, b.close > b.open AND lag(b.close > b.open) OVER (PARTITION BY tl.instrument, low_i ORDER BY b.i) AS run, min(b.low) OVER (PARTITION BY tl.instrument, low_i ORDER BY b.i) AS deepest FROM tl JOIN bars b ON b.instrument = tl.instrument AND b.i BETWEEN available + 1 AND available + 60),
ts AS (SELECT * FROM tb WHERE run AND deepest >= stop QUALIFY row_number() OVER (PARTITION BY instrument, low_i ORDER BY i) = 1),
tf AS (SELECT instrument, low_i, min(i) AS first_run FROM tb WHERE run GROUP BY 1, 2)
SELECT ts.instrument, ts.low_i, stop, ts.i AS signal_i, n.open AS entry FROM ts JOIN tf ON tf.instrument = ts.instrument AND tf.low_i = ts.low_i AND tf.first_run = ts.i JOIN bars n ON n.instrument = ts.instrument AND n.i = ts.i + 1"""

ZONE_COLUMNS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {DISP_CTE}, {BLOCKS_CTE},
zj AS (SELECT b.instrument, b.i, u.top AS ut, u.bottom AS ub, d.top AS dt, d.bottom AS db FROM bars b LEFT JOIN ob u ON u.instrument = b.instrument AND u.i = b.i AND u.direction = 1 LEFT JOIN ob d ON d.instrument = b.instrument AND d.i = b.i AND d.direction = -1)
SELECT instrument, i, last_value(ut IGNORE NULLS) OVER w AS bull_top, last_value(ub IGNORE NULLS) OVER w AS bull_bottom, last_value(dt IGNORE NULLS) OVER w AS bear_top, last_value(db IGNORE NULLS) OVER w AS bear_bottom FROM zj WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS UNBOUNDED PRECEDING)"""

QUERIES = {
    "open_gaps": _query(points.open_gaps, "points", "size_atr", "fill"),
    "equal_levels": _query(points.equal_levels, "level", "tolerance"),
    "tradable_bottoms": _query(st.tradable_bottoms),
    "order_block_zones": lambda spark, sf_dir: st.with_order_blocks(hourly(spark, sf_dir)).select("instrument", "i", "bull_top", "bull_bottom", "bear_top", "bear_bottom"),
    "swing_points": _query(st.swings),
    "last_swings": last_swings,
    "structure_breaks": _query(st.structure_breaks),
    "fair_value_gaps": _query(st.fair_value_gaps, "fill"),
    "displacements": _query(st.displacements, "body_ratio", "atr"),
    "order_blocks": _query(st.order_blocks),
    "liquidity_sweeps": lambda spark, sf_dir: _rounded(st.liquidity_sweeps(levels_long(b := hourly(spark, sf_dir), ticks(spark, sf_dir)), b), "depth"),
    "double_patterns": _query(st.double_patterns, "confidence"),
    "support_resistance": _query(st.zones, "price", "distance", "distance_atr"),
    "trend": lambda spark, sf_dir: _rounded(st.trend(hourly(spark, sf_dir)).select("instrument", "i", "slope_points", "slope", "above", "trend", "basis"), "slope_points", "slope"),
}
ORACLES = {
    "open_gaps": OPEN_GAPS,
    "equal_levels": EQUAL_LEVELS,
    "tradable_bottoms": BOTTOMS,
    "order_block_zones": ZONE_COLUMNS,
    "swing_points": f"WITH {sql.BARS}, {SWINGS} SELECT * FROM swings",
    "last_swings": f"WITH {sql.BARS}, {LAST} SELECT * EXCLUDE (ts, close) FROM ls",
    "structure_breaks": BREAKS,
    "fair_value_gaps": FVG,
    "displacements": DISP,
    "order_blocks": BLOCKS,
    "liquidity_sweeps": SWEEPS,
    "double_patterns": DOUBLES,
    "support_resistance": ZONES,
    "trend": TREND,
}
