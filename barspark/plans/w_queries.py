"""W patterns over five-minute bars, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import w_patterns as wp
from barspark.plans import sql
from barspark.plans.strategy_queries import _LINE
from barspark.sources.bars import numbered, ticks, ticks_to_bars


def _bars(spark, sf_dir):
    return numbered(ticks_to_bars(ticks(spark, sf_dir), "5 minutes"))


def _rounded(rows):
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def w_candidates(spark, sf_dir):
    return _rounded(wp.w_candidates(_bars(spark, sf_dir)))


def best_w(spark, sf_dir):
    return _rounded(wp.best_w(wp.w_candidates(_bars(spark, sf_dir))))


def way_steps(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return _rounded(wp.way_steps(wp.w_candidates(bars), bars))


def structure_steps(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return _rounded(wp.structure_steps(wp.w_candidates(bars), bars))


def stage_cells(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return _rounded(wp.stage_cells(wp.stage_entries(wp.w_candidates(bars), bars)))


BARS = sql.BARS.replace("INTERVAL 1 HOUR", "INTERVAL 5 MINUTE")

SEARCH = """ba AS (SELECT b.*, atr.y AS a, max(b.i) OVER (PARTITION BY b.instrument) AS last FROM bars b JOIN atr USING (instrument, i)),
w0 AS (SELECT *, count(*) OVER l AS nl, count(*) OVER r AS nr, min(low) OVER l AS ll, min(low) OVER r AS lr, max(high) OVER p AS before FROM ba
    WINDOW l AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), p AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 200 PRECEDING AND CURRENT ROW)),
w1 AS (SELECT instrument, i AS first_i, low AS low1, before, least(i + 200, last - 1) AS fin FROM w0 WHERE nl = 6 AND nr = 6 AND low < ll AND low <= lr AND i >= 200 AND i + 6 < last - 1),
wr AS (SELECT instrument, first_i, low1, before, fin, CAST(0 AS BIGINT) AS step, -1e300 AS top, CAST(-1 AS BIGINT) AS top_at, 1e300 AS neck, false AS back, 1e300 AS low2, CAST(-1 AS BIGINT) AS low2_at, CAST(-1 AS BIGINT) AS told, 0 AS cnt, false AS hit, true AS going, CAST(NULL AS DOUBLE) AS a FROM w1
    UNION ALL SELECT instrument, first_i, low1, before, fin, step, top, top_at, neck, back, low2, low2_at, CASE WHEN sure THEN low2_at ELSE told END, cnt + CAST(hit AS INTEGER), hit, NOT stop AND cnt + CAST(hit AS INTEGER) < 6, a
    FROM (SELECT *, sure AND a > 0 AND top > least(low1, low2) AND top - least(low1, low2) >= 2 * a AND (before - low1) / (top - least(low1, low2)) >= 0.5 AS hit
    FROM (SELECT *, look AND back AND low2_at >= 0 AND j > low2_at AND low2_at <> told AND cl - low2 >= 0.15 * span AS sure
    FROM (SELECT * EXCLUDE (neck, back, low2, low2_at), CASE WHEN near AND NOT back THEN top ELSE neck END AS neck, back OR near AS back, CASE WHEN near AND lo < low2 THEN lo ELSE low2 END AS low2, CASE WHEN near AND lo < low2 THEN j ELSE low2_at END AS low2_at
    FROM (SELECT *, look AND j > top_at AND lo <= low1 + 0.15 * span AS near
    FROM (SELECT *, act AND NOT stop AND step >= 10 AS look
    FROM (SELECT *, act AND (lo < low1 - 0.15 * span OR (step >= 10 AND back AND cl > neck)) AS stop
    FROM (SELECT *, top - low1 AS span, step >= 6 AND top > low1 AS act
    FROM (SELECT r.instrument, first_i, low1, before, fin, step + 1 AS step, greatest(top, b.high) AS top, CASE WHEN b.high > top THEN b.i ELSE top_at END AS top_at, neck, back, low2, low2_at, told, cnt, b.i AS j, b.low AS lo, b.close AS cl, b.a
        FROM wr r JOIN ba b ON b.instrument = r.instrument AND b.i = r.first_i + r.step + 1 WHERE going AND r.first_i + r.step + 1 <= fin))))))))),
wc AS (SELECT instrument, first_i, top_at AS high_i, low2_at AS second_i, first_i + step AS i, low1, low2, top AS high, (before - low1) / (top - least(low1, low2)) AS left_arm, a AS atr FROM wr WHERE hit),
dbl AS (SELECT instrument, 'double_bottom' AS pattern, first_i, second_i AS i, i AS available, low2 AS price, high AS neck, CAST(NULL AS BIGINT) AS break_i FROM wc)"""
FOUND = f"""{SEARCH}, {_LINE}, wx AS (SELECT wc.*, form_error, peak FROM wc JOIN wf ON wf.instrument = wc.instrument AND wf.first_i = wc.first_i AND wf.i = wc.second_i WHERE form_error IS NOT NULL)"""
HEAD = f"WITH RECURSIVE {BARS}, {sql.ATR}, {FOUND}"
SHOWN = "SELECT * REPLACE (round(left_arm, 6) AS left_arm, round(form_error, 6) AS form_error, round(peak, 6) AS peak, round(atr, 6) AS atr, round(low1, 6) AS low1, round(low2, 6) AS low2, round(high, 6) AS high) FROM"
CANDIDATES = f"{HEAD} {SHOWN} wx"
BEST = f"{HEAD}, b AS (SELECT * FROM wx QUALIFY row_number() OVER (PARTITION BY instrument, first_i ORDER BY form_error, i) = 1) {SHOWN} b"

WAY = """ws AS (SELECT CAST(unnest([0.15, 0.25, 0.35, 0.45, 0.55, 0.70, 0.85, 1.00]) AS DOUBLE) AS step),
wb AS (SELECT x.instrument, x.first_i, x.second_i, x.i, low2, x.high AS neck, b.i AS j, b.high AS hi, b.low AS lo, last FROM wx x JOIN ba b ON b.instrument = x.instrument AND b.i BETWEEN x.i AND x.i + 239 WHERE x.high > low2),
wg AS (SELECT instrument, first_i, second_i, i, last, min(j) FILTER (lo <= low2 - 1e-9) AS broken_i FROM wb GROUP BY ALL),
wh AS (SELECT instrument, first_i, second_i, i, step, min(j) FILTER (hi >= low2 + step * (neck - low2)) AS hit FROM wb, ws GROUP BY ALL),
wy AS (SELECT instrument, first_i, second_i, i, step, CASE WHEN hit < last AND (broken_i IS NULL OR hit < broken_i) THEN hit END AS reached_i, broken_i FROM wh JOIN wg USING (instrument, first_i, second_i, i))"""
WAYS = f"{HEAD}, {WAY} SELECT *, reached_i + 1 AS entry_i FROM wy"

LEGS = """zr AS (SELECT instrument, first_i, second_i, i, low2, leg, leg * (high - low2) AS least_, CAST(0 AS BIGINT) AS t, low2 AS mark, -1e300 AS done_top, -1e300 AS top, -1e300 AS peak, 1e300 AS since, true AS rising, CAST(0 AS BIGINT) AS step, false AS made, false AS broken, leg * (high - low2) > 0 AS going, CAST(NULL AS BIGINT) AS j
        FROM wx, (SELECT CAST(unnest([0.10, 0.20]) AS DOUBLE) AS leg)
    UNION ALL SELECT instrument, first_i, second_i, i, low2, leg, least_, t + 1, CASE WHEN turned THEN since ELSE mark END, CASE WHEN turned THEN peak ELSE done_top END, CASE WHEN turned THEN -1e300 ELSE top END, peak, since,
        CASE WHEN made THEN false WHEN turned THEN true ELSE rising END, step + CAST(made AS BIGINT), made, broken, NOT broken AND step + CAST(made AS BIGINT) < 6, j
    FROM (SELECT *, down AND peak - since >= least_ AS turned
    FROM (SELECT * EXCLUDE (mark, peak, since), CASE WHEN up AND NOT made THEN least(mark, lo) ELSE mark END AS mark, CASE WHEN made THEN top WHEN down THEN greatest(peak, hi) ELSE peak END AS peak, CASE WHEN made THEN lo WHEN down THEN CASE WHEN hi > peak THEN lo ELSE least(since, lo) END ELSE since END AS since
    FROM (SELECT *, up AND top - mark >= least_ AND top > done_top AS made
    FROM (SELECT * EXCLUDE top, CASE WHEN up THEN greatest(top, hi) ELSE top END AS top
    FROM (SELECT *, rising AND NOT broken AS up, NOT rising AND NOT broken AS down
    FROM (SELECT r.* EXCLUDE (made, broken, going, j), b.i AS j, b.high AS hi, b.low AS lo, b.low < r.low2 AS broken FROM zr r JOIN ba b ON b.instrument = r.instrument AND b.i = r.i + r.t WHERE going AND t < 240))))))),
zo AS (SELECT x.instrument, x.first_i, x.second_i, x.i, leg, step, last FROM wx x, (SELECT CAST(unnest([0.10, 0.20]) AS DOUBLE) AS leg), (SELECT unnest(range(1, 7)) AS step), (SELECT DISTINCT instrument AS n, last FROM ba) WHERE n = x.instrument),
zz AS (SELECT zo.instrument, zo.first_i, zo.second_i, zo.i, zo.leg, zo.step, CASE WHEN m.j < last THEN m.j END AS reached_i, g.j AS broken_i FROM zo
    LEFT JOIN zr m ON m.made AND m.instrument = zo.instrument AND m.first_i = zo.first_i AND m.second_i = zo.second_i AND m.leg = zo.leg AND m.step = zo.step
    LEFT JOIN zr g ON g.broken AND g.instrument = zo.instrument AND g.first_i = zo.first_i AND g.second_i = zo.second_i AND g.leg = zo.leg)"""
LADDER = f"{HEAD}, {LEGS} SELECT *, reached_i + 1 AS entry_i FROM zz"

_STOPS = ", ".join([f"{{'n': 'share_{s:.2f}', 'p': low2 - {s} * height}}" for s in wp.STOP_SHARES] + [f"{{'n': 'points_{p:.0f}', 'p': low2 - {p}}}" for p in wp.STOP_POINTS])
_TARGETS = ", ".join(f"{{'n': 'share_{t:+.2f}', 'p': high - ({t}) * height}}" for t in wp.TARGET_SHARES)
_MEDIANS = {"median_r": "r", "reward_risk": "reward / risk", "mfe_r": "mfe / risk", "mae_r": "mae / risk", "mfe_r_horizon": "mfe_horizon / risk", "above_low": "(entry - low2) / height", "left_to_neck": "(high - entry) / height"}
CELLS = f"""{HEAD}, {WAY}, {LEGS},
en0 AS (SELECT instrument, first_i, second_i, printf('way_%.2f', step) AS stage, reached_i + 1 AS e FROM wy WHERE reached_i IS NOT NULL UNION ALL SELECT instrument, first_i, second_i, printf('leg%.0f%%_%d', leg * 100, step), reached_i + 1 FROM zz WHERE reached_i IS NOT NULL),
en AS (SELECT en0.*, low2, x.high, x.high - least(low1, low2) AS height, form_error FROM en0 JOIN wx x USING (instrument, first_i, second_i)),
eb AS (SELECT en.*, list(b.high ORDER BY b.i) AS hs, list(b.low ORDER BY b.i) AS ls, arg_min(b.open, b.i) AS entry, arg_max(b.close, b.i) AS fin, year(arg_min(b.ts, b.i)) AS year FROM en JOIN ba b ON b.instrument = en.instrument AND b.i BETWEEN en.e AND en.e + 239 GROUP BY ALL HAVING count(*) = 240),
el AS (SELECT *, list_transform([{_STOPS}], lambda s: {{'n': s.n, 'p': s.p, 't': coalesce(list_position(list_transform(ls, lambda x: x <= s.p), true), 0)}}) AS stops, list_transform([{_TARGETS}], lambda s: {{'n': s.n, 'p': s.p, 't': coalesce(list_position(list_transform(hs, lambda x: x >= s.p), true), 0)}}) AS targets FROM eb),
ex AS (SELECT * EXCLUDE (stops), unnest(stops) AS s FROM el), ey AS (SELECT * EXCLUDE (targets), unnest(targets) AS g FROM ex),
ez AS (SELECT *, s.n AS stop, g.n AS target, entry - s.p AS risk, g.p - entry AS reward, s.t AS sa, g.t AS ta, least(CASE WHEN s.t > 0 THEN s.t ELSE 240 END, CASE WHEN g.t > 0 THEN g.t ELSE 240 END) AS out_ FROM ey WHERE entry - s.p >= 2 AND g.p > entry),
fa AS (SELECT *, list_max(hs[1:out_]) - entry AS mfe, entry - list_min(ls[1:out_]) AS mae, list_max(hs) - entry AS mfe_horizon, ta > 0 AND (sa = 0 OR ta < sa) AS won, sa > 0 AND (ta = 0 OR sa <= ta) AS stopped FROM ez),
fb AS (SELECT *, (CASE WHEN won THEN reward WHEN stopped THEN -risk ELSE fin - entry END - 1.45) / risk AS r FROM fa),
fq AS (SELECT stage, stop, target, quantile_cont(form_error, [0.25, 0.5, 0.75]) AS q FROM fb GROUP BY ALL HAVING count(*) >= 30),
fg AS (SELECT fb.*, unnest(['all', 'quarter_' || CASE WHEN form_error < q[1] THEN 1 WHEN form_error < q[2] THEN 2 WHEN form_error < q[3] THEN 3 ELSE 4 END, 'year_' || year]) AS part FROM fb JOIN fq USING (stage, stop, target)),
fh AS (SELECT stage, stop, target, part, count(*) AS n, count(*) FILTER (won OR stopped) AS decided, count(*) FILTER (won) AS target_first, count(*) FILTER (stopped) AS stop_first, count(*) FILTER (NOT won AND NOT stopped) AS open, count(*) FILTER (stopped AND sa = ta) AS ambiguous,
    avg(risk / (risk + reward)) FILTER (won OR stopped) AS geometry, avg(r) AS mean_r, stddev_samp(r) AS sd, {", ".join(f"quantile_cont({x}, 0.5) AS {k}" for k, x in _MEDIANS.items())}, avg(CASE WHEN stopped AND mfe >= 0.5 * risk THEN 1.0 ELSE 0.0 END) AS ran_then_stopped,
    quantile_cont(CAST(ta AS DOUBLE), 0.5) FILTER (won) AS bars_to_target, quantile_cont(CAST(sa AS DOUBLE), 0.5) FILTER (stopped) AS bars_to_stop, count(DISTINCT year) AS years FROM fg GROUP BY ALL HAVING count(*) >= 30)
SELECT stage, stop, target, part, n, decided, target_first, stop_first, open, ambiguous, years, {", ".join(f"round({c}, 6) AS {c}" for c in ("geometry", "mean_r", *_MEDIANS, "ran_then_stopped", "bars_to_target", "bars_to_stop"))},
    round(target_first / nullif(decided, 0), 6) AS hit_rate, round(target_first / nullif(decided, 0) - geometry, 6) AS edge, round(CASE WHEN sd > 0 THEN mean_r / (sd / sqrt(n)) END, 6) AS t FROM fh"""

QUERIES = {"w_candidates": w_candidates, "best_w": best_w, "way_steps": way_steps, "structure_steps": structure_steps, "stage_cells": stage_cells}
ORACLES = {"w_candidates": CANDIDATES, "best_w": BEST, "way_steps": WAYS, "structure_steps": LADDER, "stage_cells": CELLS}
