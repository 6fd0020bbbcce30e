"""Coverage, comparison and risk queries, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import levels as lv
from barspark.operators import monitor as mo
from barspark.operators.structure import swings
from barspark.plans import sql
from barspark.plans.event_queries import TRADES, _trades
from barspark.plans.structure_queries import SWINGS
from barspark.sources.bars import hourly


def _rounded(rows, *columns):
    for c in columns:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


def _at(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def refreshed(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return mo.refreshed(lv.resample(bars, 240), bars, 240, _at("2024-01-20"))


def swing_look_ahead(spark, sf_dir):
    rows = swings(hourly(spark, sf_dir)).withColumn("origin", F.col("i"))
    return rows.agg(F.count("*").alias("swings")).crossJoin(mo.look_ahead(rows).agg(F.count("*").alias("early")))  # one row each


QUERIES = {
    "risk_check": lambda s, d: mo.risk_checked(_trades(s, d), "strategy", ["ts", "k"], F.col("k") % 1440, F.col("risk")).select("strategy", "k", "profile", F.array_join("broken", ",").alias("broken")),
    "coverage": lambda s, d: _rounded(mo.coverage(hourly(s, d), _at("2024-01-31")), "age_hours"),
    "seam_check": lambda s, d: _rounded(mo.seam(hourly(s, d), _at("2024-01-15")), "days", "jump"),
    "volume_so_far": lambda s, d: _rounded(mo.volume_so_far(hourly(s, d)).select("instrument", "i", "so_far", "ratio"), "ratio"),
    "atr_percentile": lambda s, d: _rounded(mo.atr_percentile(hourly(s, d)).select("instrument", "i", "percentile"), "percentile"),
    "risk_figures": lambda s, d: _rounded(mo.risk_figures(_trades(s, d), "strategy", 5000.0), "net", "worst_day", "highest", "below_highest"),
    "refreshed_bars": refreshed,
    "swing_look_ahead": swing_look_ahead,
    "equity_curve": lambda s, d: _rounded(mo.equity_curve(_trades(s, d), "strategy", ["ts", "k"]).select("strategy", "k", "ts", "equity", "fall"), "equity", "fall"),
    "forward_paths": lambda s, d: mo.paths(hourly(s, d), 5).select("instrument", "i", "entry", F.size("path").cast("long").alias("n"), F.round(F.element_at("path", -1), 6).alias("last")),
}
ORACLES = {
    "risk_check": f"""WITH {TRADES}, a AS (SELECT *, coalesce(sum(pnl) OVER (PARTITION BY strategy ORDER BY ts, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far, coalesce(sum(pnl) OVER (PARTITION BY strategy, CAST(ts AS DATE) ORDER BY ts, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS today FROM tr),
b AS (SELECT *, greatest(0.0, max(so_far) OVER (PARTITION BY strategy ORDER BY ts, k)) - so_far AS below FROM a), p AS (SELECT unnest(['small', 'large']) AS profile, unnest([570, 480]) AS f, unnest([960, 1020]) AS e, unnest([2000.0, 20000.0]) AS loss, unnest([20000.0, 60000.0]) AS dd, unnest([20, 60]) AS most)
SELECT strategy, k, profile, concat_ws(',', CASE WHEN k % 1440 < f OR k % 1440 >= e THEN 'outside_hours' END, CASE WHEN today <= -loss THEN 'day_loss' END, CASE WHEN below >= dd THEN 'drawdown' END, CASE WHEN risk > most THEN 'contracts' END) AS broken FROM b CROSS JOIN p""",
    "swing_look_ahead": f"WITH {sql.BARS}, {SWINGS} SELECT count(*) AS swings, count(*) FILTER (i > available OR i < 0) AS early FROM swings",
    "coverage": f"WITH {sql.BARS}, g AS (SELECT instrument, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1) SELECT *, round(epoch(TIMESTAMP '2024-01-31' - last_ts) / 3600, 6) AS age_hours, epoch(TIMESTAMP '2024-01-31' - last_ts) / 3600 > 3 AS stale FROM g",
    "seam_check": f"""WITH {sql.BARS}, g AS (SELECT instrument, max(ts) FILTER (ts < TIMESTAMP '2024-01-15') AS left_ts, arg_max(close, ts) FILTER (ts < TIMESTAMP '2024-01-15') AS left_close, min(ts) FILTER (ts >= TIMESTAMP '2024-01-15') AS right_ts, arg_min(open, ts) FILTER (ts >= TIMESTAMP '2024-01-15') AS right_open FROM bars GROUP BY 1),
x AS (SELECT *, epoch(right_ts - left_ts) / 86400 AS d, abs(right_open - left_close) / nullif(abs(left_close), 0) * 100 AS j FROM g) SELECT instrument, left_ts, left_close, right_ts, right_open, round(d, 6) AS days, round(j, 6) AS jump, coalesce(d <= 4 AND j <= 3, false) AS fits FROM x""",
    "volume_so_far": f"""WITH {sql.BARS}, x AS (SELECT *, {sql.SESSION} AS session, hour(ts) * 60 + minute(ts) AS clock FROM bars), y AS (SELECT *, sum(volume) OVER (PARTITION BY instrument, session ORDER BY ts) AS so_far FROM x)
SELECT instrument, i, so_far, round(so_far / nullif(avg(so_far) OVER (PARTITION BY instrument, clock ORDER BY session ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 6) AS ratio FROM y""",
    "atr_percentile": f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, x AS (SELECT b.instrument, b.i, b.ts, atr.y AS a, list(atr.y) FILTER (atr.y IS NOT NULL) OVER (PARTITION BY b.instrument, hour(ts) * 60 + minute(ts) ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS p FROM bars b JOIN atr USING (instrument, i))
SELECT instrument, i, round(CASE WHEN a IS NOT NULL AND len(p) >= 3 THEN len(list_filter(p, lambda q: q < a)) / len(p) END, 6) AS percentile FROM x""",
    "risk_figures": f"WITH {TRADES}, d AS (SELECT strategy, CAST(ts AS DATE) AS day, sum(pnl) AS pnl FROM tr GROUP BY 1, 2), t AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy ORDER BY day) AS total FROM d), g AS (SELECT strategy, sum(pnl) AS net, min(pnl) AS worst_day, count(*) FILTER (pnl <= -5000) AS locked_days, greatest(0.0, max(total)) AS highest FROM t GROUP BY 1) SELECT strategy, round(net, 6) AS net, round(worst_day, 6) AS worst_day, locked_days, round(highest, 6) AS highest, round(highest - net, 6) AS below_highest FROM g",
    "refreshed_bars": f"WITH {sql.BARS}, x AS (SELECT *, time_bucket(INTERVAL 4 HOUR, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01') + INTERVAL 4 HOUR AS bucket FROM bars) SELECT instrument, bucket AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM x GROUP BY instrument, bucket",
    "equity_curve": f"WITH {TRADES}, e AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy ORDER BY ts, k) AS equity FROM tr) SELECT strategy, k, ts, round(equity, 6) AS equity, round(greatest(0.0, max(equity) OVER (PARTITION BY strategy ORDER BY ts, k)) - equity, 6) AS fall FROM e",
    "forward_paths": f"WITH {sql.BARS}, x AS (SELECT instrument, i, lead(open) OVER w AS entry, list(close) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS c FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i)) SELECT instrument, i, entry, CAST(len(c) AS BIGINT) AS n, round(c[-1] - entry, 6) AS last FROM x WHERE entry IS NOT NULL",
}
