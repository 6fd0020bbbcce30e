"""Conditional outcomes over hourly bars, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import conditional as co
from barspark.operators import indicators as ind
from barspark.plans import sql
from barspark.plans.research_queries import RSI
from barspark.sources.bars import hourly

def _hits(spark, sf_dir):
    named = {"weak": (F.col("rsi") < 40, 1), "strong": (F.col("rsi") > 60, -1), "rising": (F.col("close") > F.col("open"), 1)}
    return co.occurrences(ind.rsi(hourly(spark, sf_dir)), named)


def _rounded(rows):
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def conditional_report(spark, sf_dir):
    return _rounded(co.conditional_report(*_hits(spark, sf_dir)))


def conditional_grid(spark, sf_dir):
    return _rounded(co.conditional_grid(_hits(spark, sf_dir)[0]))


PATHS = """ba AS (SELECT b.*, atr.y AS a, rsi, max(b.i) OVER (PARTITION BY b.instrument) AS last FROM bars b JOIN atr USING (instrument, i) LEFT JOIN rsi USING (instrument, i)),
pa AS (SELECT x.instrument, x.i, x.open, x.close, x.rsi, CASE WHEN x.a > 0 THEN x.a ELSE 5.0 END AS u, list(b.high ORDER BY b.i) AS hs, list(b.low ORDER BY b.i) AS ls, arg_min(b.open, b.i) AS entry, arg_max(b.close, b.i) AS fin
    FROM ba x JOIN ba b ON b.instrument = x.instrument AND b.i BETWEEN x.i + 1 AND x.i + 20 WHERE x.i + 21 <= x.last GROUP BY ALL),
pb AS (SELECT *, list_max(hs) AS top, list_min(ls) AS bottom FROM pa),
pc AS (SELECT *, greatest(0, top - entry) / u AS up, greatest(0, entry - bottom) / u AS down, CASE WHEN top > entry THEN list_position(hs, top) ELSE 0 END AS up_at, CASE WHEN bottom < entry THEN list_position(ls, bottom) ELSE 0 END AS down_at, (fin - entry) / u AS f FROM pb),
ev AS (SELECT instrument, i, open, close, rsi, CAST(1 AS BIGINT) AS direction, up AS mfe, down AS mae, up_at, down_at, f FROM pc UNION ALL SELECT instrument, i, open, close, rsi, -1, down, up, down_at, up_at, -f FROM pc),
hi AS (SELECT *, 'weak' AS condition FROM ev WHERE rsi < 40 AND direction = 1 UNION ALL SELECT *, 'strong' FROM ev WHERE rsi > 60 AND direction = -1 UNION ALL SELECT *, 'rising' FROM ev WHERE close > open AND direction = 1)"""
REPORT = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {RSI}, {PATHS},
ch AS (SELECT instrument, condition, min(i) AS i FROM hi GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT h.instrument, h.condition, min(h.i) AS i FROM ch JOIN hi h ON h.instrument = ch.instrument AND h.condition = ch.condition AND h.i >= ch.i + 20 GROUP BY ALL)),
fr AS (SELECT condition, direction, count(*) AS k, avg(f) AS m, stddev_samp(f) AS s FROM hi JOIN ch USING (instrument, condition, i) GROUP BY ALL),
bs AS (SELECT direction, count(*) AS n_base, avg(f) AS bm FROM ev GROUP BY 1),
ag AS (SELECT condition, direction, count(*) AS n, avg(f) AS mean, stddev_samp(f) AS sd, quantile_cont(f, 0.5) AS median, quantile_cont(mfe, 0.5) AS fm, quantile_cont(mae, 0.5) AS am FROM hi GROUP BY ALL)
SELECT condition, direction, n, n_base, k AS n_independent, round(mean, 6) AS mean_r, round(median, 6) AS median_r, round(fm, 6) AS mfe_r_median, round(am, 6) AS mae_r_median, round(bm, 6) AS base_mean_r, round(mean - bm, 6) AS edge_r,
    round(CASE WHEN k >= 2 AND s > 0 THEN (m - bm) / (s / sqrt(k)) ELSE 0 END, 6) AS t, round(CASE WHEN n >= 2 AND sd > 0 THEN (mean - bm) / (sd / sqrt(n)) ELSE 0 END, 6) AS t_overlapping FROM ag JOIN fr USING (condition, direction) JOIN bs USING (direction)"""
GRID = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {RSI}, {PATHS},
g AS (SELECT condition, direction, CAST(target AS DOUBLE) AS target, CAST(stop AS DOUBLE) AS stop, mfe >= target AS up, mae >= stop AS down, down_at <= up_at AS first FROM hi, (SELECT unnest([1.0, 1.5, 2.0, 3.0]) AS target), (SELECT unnest([1.0, 1.5, 2.0]) AS stop)),
c AS (SELECT condition, direction, target, stop, count(*) AS n, count(*) FILTER (up AND NOT (down AND first)) AS hits, count(*) FILTER (down AND (NOT up OR first)) AS losses, count(*) FILTER (NOT up AND NOT down) AS neither FROM g GROUP BY ALL)
SELECT *, round(coalesce(hits / nullif(hits + losses, 0), 0), 6) AS win_rate FROM c"""

QUERIES = {"conditional_report": conditional_report, "conditional_grid": conditional_grid}
ORACLES = {"conditional_report": REPORT, "conditional_grid": GRID}
