"""Event, rule and trade queries, with the SQL they are compared with."""

from __future__ import annotations

from datetime import time

from pyspark.sql import functions as F

from barspark.operators import backtest as bt
from barspark.operators import events as ev
from barspark.operators import indicators as ind
from barspark.operators import rules as ru
from barspark.operators.levels import levels_long
from barspark.plans import sql
from barspark.plans.structure_queries import BLOCKS_CTE, BREAKS_CTE, DISP_CTE, EQUAL_CTE, FVG_CTE, LAST, LEVELS_CTE, SWEEPS_CTE
from barspark.sources.bars import hourly, ticks


def _rounded(rows, *columns):
    for c in columns:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


def _detected(spark, sf_dir):
    return ev.detected(hourly(spark, sf_dir), ticks(spark, sf_dir))


def forward_outcomes(spark, sf_dir):
    rows = ev.outcomes(_detected(spark, sf_dir), hourly(spark, sf_dir))
    return _rounded(rows, "atr", "mfe", "mae", "end_points", "mfe_r", "mae_r", "end_r")


def barrier_grid(spark, sf_dir):
    return _rounded(ev.barrier_grid(ev.first_touches(_detected(spark, sf_dir), hourly(spark, sf_dir))), "expectancy")


def base_rates(spark, sf_dir):
    rates = ev.base_rates(ev.outcomes(ev.clusters(_detected(spark, sf_dir)), hourly(spark, sf_dir), (10,)), 10)
    return _rounded(rates, *(c for c, t in rates.dtypes if t == "double"))


def base_rates_by_variant(spark, sf_dir):
    rates = ev.base_rates(ev.outcomes(ev.clusters(_detected(spark, sf_dir)), hourly(spark, sf_dir), (10,)), 10, by=("variant",))
    return _rounded(rates, *(c for c, t in rates.dtypes if t == "double"))


def event_clusters(spark, sf_dir):
    return ev.clusters(_detected(spark, sf_dir))


def event_counts(spark, sf_dir):
    return _detected(spark, sf_dir).groupBy("pattern", "variant", "direction").agg(F.count("*").alias("n"))


def event_look_ahead(spark, sf_dir):
    """Events of each detector that claim to be known before they begin or after the series ends; there must be none."""
    last = hourly(spark, sf_dir).groupBy("instrument").agg(F.max("i").alias("last_i"))
    early = (F.col("origin") > F.col("i")) | (F.col("origin") < 0) | (F.col("i") > F.col("last_i"))
    return _detected(spark, sf_dir).join(last, "instrument").groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(early).alias("early"))


def non_overlapping(spark, sf_dir):
    # of events that begin at one bar only one is kept, whichever it is
    return ev.non_overlapping(_detected(spark, sf_dir).select("instrument", "i", "direction", "pattern"), 10)


def _rule_bars(spark, sf_dir):
    rows = ind.session_vwap(ind.rsi(ind.atr(hourly(spark, sf_dir))))
    return rows.withColumn("sma20", ind.over_last(F.avg, "close", 20))


ENTRIES = {
    "cross_up": (ru.CrossesAbove("close", "sma20") & ru.Above("close", "vwap"), 1),
    "cross_down": (ru.CrossesBelow("close", "sma20") & ru.Below("close", "vwap"), -1),
    "oversold": (ru.Below("rsi", 40.0) & ru.Rising("close") & ~ru.InTime(time(16), time(18)), 1),
    "reversion": (ru.WasFarFrom("close", "vwap", "atr", 1.0) & ru.Falling("close"), -1),
}


def rule_signals(spark, sf_dir):
    return _rounded(ru.signals(_rule_bars(spark, sf_dir), ENTRIES), "stop", "target")


def backtest(spark, sf_dir):
    rows = _rule_bars(spark, sf_dir)
    rows = rows.withColumn("go_long", ENTRIES["cross_up"][0].column()).withColumn("go_short", ENTRIES["cross_down"][0].column())
    return _rounded(bt.positions(rows, 1.5, 3.0, 8), "entry", "exit", "pnl")


def _trades(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") * (5 - F.round(F.col("l_discount") * 100).cast("long"))) / 10000.0).alias("pnl"), F.sum("l_quantity").alias("risk"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").alias("ts"))
    return orders.join(lines, "k")


def trade_metrics(spark, sf_dir):
    return _rounded(bt.trade_metrics(_trades(spark, sf_dir), "strategy", ["ts", "k"]), "gross_profit", "gross_loss", "mean", "drawdown", "profit_factor")


def daily_sharpe(spark, sf_dir):
    return _rounded(bt.daily_sharpe(_trades(spark, sf_dir), "strategy"), "sharpe")


def factor_test(spark, sf_dir):
    return _rounded(bt.factor_test(_trades(spark, sf_dir).withColumn("weekday", F.weekday("ts").cast("long")), "weekday"), "won", "mean", "sd", "t")


def walk_forward(spark, sf_dir):
    rows = bt.walk_forward(hourly(spark, sf_dir), 200, 100, 100)
    return rows.groupBy("instrument", "start", "part").agg(F.count("*").alias("n"), F.round(F.sum(F.col("close") - F.col("open")), 6).alias("net"))


TRADES = """tr AS (SELECT o_orderkey AS k, o_orderpriority AS strategy, o_orderdate AS ts, pnl, risk FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (5 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE) / 10000.0 AS pnl, sum(l_quantity) AS risk FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""

INTERACTIONS_CTE = """li AS (SELECT *, 0.1 * a AS w, row_number() OVER (PARTITION BY instrument, name ORDER BY i) AS q FROM lv),
lr AS (SELECT instrument, name, CAST(0 AS BIGINT) AS q, CAST(NULL AS BIGINT) AS i, CAST(0 AS BIGINT) AS side, CAST(NULL AS BIGINT) AS broke, CAST(0 AS BIGINT) AS bdir, CAST(0 AS DOUBLE) AS blevel, false AS retested, CAST(0 AS BIGINT) AS tests, CAST(-1000000 AS BIGINT) AS tested,
        CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS BIGINT) AS o1, CAST(NULL AS BIGINT) AS d1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS BIGINT) AS d2, CAST(NULL AS BIGINT) AS n2 FROM li WHERE q = 1
    UNION ALL SELECT instrument, name, q, i, CASE WHEN abs(close - level) > w THEN CASE WHEN close > level THEN 1 ELSE -1 END WHEN brk <> 0 THEN brk ELSE side END,
        CASE WHEN brk <> 0 THEN i ELSE broke END, CASE WHEN brk <> 0 THEN brk ELSE bdir END, CASE WHEN brk <> 0 THEN level ELSE blevel END, brk = 0 AND retested,
        CASE WHEN brk <> 0 THEN 0 WHEN touch THEN CASE WHEN i - tested > 60 THEN 0 ELSE tests END + 1 ELSE tests END, CASE WHEN touch THEN i ELSE tested END,
        k1, o1, d1, CASE WHEN brk <> 0 THEN 'break' WHEN touch THEN 'test' END, CASE WHEN brk <> 0 THEN brk WHEN touch THEN CASE WHEN side = 1 OR (side = 0 AND pc0 > level) THEN 1 ELSE -1 END END,
        CASE WHEN brk <> 0 THEN tests WHEN touch THEN CASE WHEN i - tested > 60 THEN 0 ELSE tests END + 1 END
    FROM (SELECT *, brk = 0 AND abs(close - level) <= w AND low <= level + w AND high >= level - w AS touch FROM (
        SELECT *, CASE WHEN side = -1 AND close > level + w THEN 1 WHEN side = 1 AND close < level - w THEN -1 ELSE 0 END AS brk FROM (
            SELECT instrument, name, q, i, high, low, close, pc0, w, level, tests, tested, CASE WHEN back THEN -bdir ELSE side END AS side, CASE WHEN back OR over THEN NULL ELSE broke END AS broke, bdir, blevel, (retested OR hold) AND NOT back AND NOT over AS retested,
                CASE WHEN back THEN 'false_break' WHEN hold THEN 'retest' END AS k1, CASE WHEN back OR hold THEN broke END AS o1, CASE WHEN back THEN -bdir WHEN hold THEN bdir END AS d1
            FROM (SELECT *, coalesce(NOT back AND i - broke > 60, false) AS over, coalesce(NOT back AND i - broke <= 60 AND NOT retested AND low <= blevel + w AND high >= blevel - w AND bdir * (close - blevel) > 0, false) AS hold
                FROM (SELECT l.*, r.side, r.broke, r.bdir, r.blevel, r.retested, r.tests, r.tested, coalesce(l.i - r.broke <= 20 AND r.bdir * (r.blevel - l.close) > l.w, false) AS back FROM lr r JOIN li l ON l.instrument = r.instrument AND l.name = r.name AND l.q = r.q + 1))))))
,
lint AS (SELECT instrument, name, o1 AS origin, i, k1 AS kind, d1 AS direction, CAST(NULL AS BIGINT) AS tests FROM lr WHERE k1 IS NOT NULL UNION ALL SELECT instrument, name, i, i, k2, d2, n2 FROM lr WHERE k2 IS NOT NULL)"""

#: All seven detectors: evs has their events.
EVENTS = f"""{sql.ATR}, {sql.TICKS}, {LAST}, {BREAKS_CTE}, {FVG_CTE}, {DISP_CTE}, {BLOCKS_CTE}, {EQUAL_CTE}, {LEVELS_CTE}, {SWEEPS_CTE}, {INTERACTIONS_CTE},
evs AS (SELECT instrument, origin, i, direction, variant AS pattern, '' AS variant FROM brk UNION ALL SELECT instrument, origin, i, direction, 'fair_value_gap', '' FROM fvg UNION ALL SELECT instrument, i, i, direction, 'displacement', '' FROM disp
    UNION ALL SELECT instrument, origin, i, direction, 'order_block', '' FROM ob UNION ALL SELECT instrument, first, available, CASE WHEN kind = 'high' THEN -1 ELSE 1 END, 'equal_' || kind || 's', 'n' || members FROM eq
    UNION ALL SELECT instrument, origin, i, direction, 'level_' || kind, name FROM lint UNION ALL SELECT instrument, origin, i, direction, 'sweep', name FROM swp)"""

CLUSTERS_CTE = """cr AS (SELECT instrument, direction, min(i) AS anchor FROM evs GROUP BY 1, 2 UNION ALL SELECT * FROM (SELECT e.instrument, e.direction, min(e.i) AS anchor FROM cr JOIN evs e ON e.instrument = cr.instrument AND e.direction = cr.direction AND e.i > cr.anchor + 3 GROUP BY 1, 2)),
cl AS (SELECT e.*, anchor FROM evs e ASOF JOIN cr ON e.instrument = cr.instrument AND e.direction = cr.direction AND e.i >= cr.anchor),
cls AS (SELECT * EXCLUDE anchor, 'C' || CASE WHEN direction > 0 THEN '+' ELSE '' END || direction || '-' || lpad(CAST(anchor AS VARCHAR), 9, '0') AS cluster_id, count(*) OVER (PARTITION BY instrument, direction, anchor) AS size FROM cl)"""

AHEAD_CTE = """ah AS (SELECT instrument, i, lead(open) OVER o AS entry, list(high) OVER n AS hs, list(low) OVER n AS lows, list(close) OVER n AS cs FROM bars
    WINDOW o AS (PARTITION BY instrument ORDER BY i), n AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 240 FOLLOWING))"""


def _outcomes_cte(events: str, horizons) -> str:
    return f"""{AHEAD_CTE}, hz AS (SELECT CAST(unnest([{", ".join(map(str, horizons))}]) AS BIGINT) AS horizon),
oj AS (SELECT e.*, horizon, entry, atr.y AS atr, hs[1:horizon] AS h, lows[1:horizon] AS l, cs[horizon] AS c FROM {events} e JOIN ah USING (instrument, i) JOIN atr USING (instrument, i) CROSS JOIN hz WHERE len(hs) >= horizon),
om AS (SELECT *, list_max(h) AS t, list_min(l) AS b FROM oj),
oo AS (SELECT *, greatest(0.0, CASE WHEN direction = 1 THEN t - entry ELSE entry - b END) AS mfe, greatest(0.0, CASE WHEN direction = 1 THEN entry - b ELSE t - entry END) AS mae, CASE WHEN c = entry THEN 0.0 ELSE direction * (c - entry) END AS ep,
    CAST(list_position(h, t) AS BIGINT) AS ta, CAST(list_position(l, b) AS BIGINT) AS ba, CASE WHEN atr > 0 THEN atr END AS r FROM om)"""


OUTCOMES = f"""WITH RECURSIVE {sql.BARS}, {EVENTS}, {_outcomes_cte("evs", ev.HORIZONS)}
SELECT instrument, origin, i, direction, pattern, variant, horizon, entry, round(atr, 6) AS atr, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(ep, 6) AS end_points, CASE WHEN direction = 1 THEN ta ELSE ba END AS mfe_at, CASE WHEN direction = 1 THEN ba ELSE ta END AS mae_at,
    round(mfe / r, 6) AS mfe_r, round(mae / r, 6) AS mae_r, round(ep / r, 6) AS end_r FROM oo"""

BARRIERS = f"""WITH RECURSIVE {sql.BARS}, {EVENTS}, {AHEAD_CTE},
bk AS (SELECT CAST(unnest([0.5, 1.0, 1.5, 2.0, 3.0]) AS DOUBLE) AS multiple),
bj AS (SELECT e.instrument, e.i, e.direction, pattern, entry, atr.y AS atr, hs, lows FROM (SELECT DISTINCT instrument, i, direction, pattern FROM evs) e JOIN ah USING (instrument, i) JOIN atr USING (instrument, i) WHERE atr.y >= 1 AND len(hs) = 240),
bt AS (SELECT bj.* EXCLUDE (hs, lows), multiple, nullif(coalesce(list_position(list_transform(hs, lambda x: x >= entry + multiple * atr), true), 0), 0) AS above, nullif(coalesce(list_position(list_transform(lows, lambda x: x <= entry - multiple * atr), true), 0), 0) AS below FROM bj CROSS JOIN bk),
bd AS (SELECT *, CASE WHEN direction = 1 THEN above ELSE below END AS ta, CASE WHEN direction = 1 THEN below ELSE above END AS sa FROM bt),
bg AS (SELECT a.pattern, a.direction, a.multiple AS target, b.multiple AS stop, count(*) AS n, count(*) FILTER (a.ta IS NOT NULL AND (b.sa IS NULL OR a.ta < b.sa)) AS hits, count(*) FILTER (b.sa IS NOT NULL AND (a.ta IS NULL OR b.sa <= a.ta)) AS losses, count(*) FILTER (a.ta = b.sa) AS ambiguous
    FROM bd a JOIN bd b USING (instrument, i, direction, pattern) GROUP BY 1, 2, 3, 4)
SELECT *, round((hits * target - losses * stop) / nullif(hits + losses, 0), 6) AS expectancy FROM bg"""

_Z = "CASE WHEN {n1} > 0 AND {n2} > 0 AND ({x1} + {x2}) / ({n1} + {n2}) * (1 - ({x1} + {x2}) / ({n1} + {n2})) * (1 / {n1} + 1 / {n2}) > 0 THEN ({x1} / {n1} - {x2} / {n2}) / sqrt(({x1} + {x2}) / ({n1} + {n2}) * (1 - ({x1} + {x2}) / ({n1} + {n2})) * (1 / {n1} + 1 / {n2})) ELSE 0.0 END"

RATES = f"""WITH RECURSIVE {sql.BARS}, {EVENTS}, {CLUSTERS_CTE}, {_outcomes_cte("cls", [10])},
rr AS (SELECT instrument, i, direction, pattern AS kind, instrument || '/' || cluster_id AS cluster, ep > 0 AS won, atr, ep / r AS er, greatest(-25.0, least(25.0, ep / r)) AS x, mfe / r AS mf, mae / r AS ma FROM oo WHERE ep / r IS NOT NULL),
dr AS (SELECT kind, direction, count(*) FILTER (NOT atr >= 1) AS n_dropped_atr FROM rr GROUP BY 1, 2), r1 AS (SELECT * FROM rr WHERE atr >= 1),
ea AS (SELECT g.kind AS pattern, r1.*, g.kind = r1.kind AS own FROM r1 JOIN (SELECT DISTINCT kind, direction FROM r1) g ON g.direction = r1.direction),
er0 AS (SELECT *, row_number() OVER (PARTITION BY pattern, direction, own, instrument ORDER BY i, kind, cluster, won, x) AS q FROM ea),
fr AS (SELECT instrument, direction, pattern, own, min(i) AS i FROM ea GROUP BY 1, 2, 3, 4
    UNION ALL SELECT * FROM (SELECT e.instrument, e.direction, e.pattern, e.own, min(e.i) AS i FROM fr JOIN ea e ON e.instrument = fr.instrument AND e.direction = fr.direction AND e.pattern = fr.pattern AND e.own = fr.own AND e.i >= fr.i + 10 GROUP BY 1, 2, 3, 4)),
e1 AS (SELECT er0.*, fr.i IS NOT NULL AND row_number() OVER (PARTITION BY er0.instrument, er0.direction, er0.pattern, er0.own, er0.i ORDER BY q) = 1 AS free FROM er0 LEFT JOIN fr ON fr.instrument = er0.instrument AND fr.direction = er0.direction AND fr.pattern = er0.pattern AND fr.own = er0.own AND fr.i = er0.i),
gg AS (SELECT pattern, direction, count(*) FILTER (own) AS n, count(*) FILTER (NOT own) AS m, count(*) FILTER (own AND free) AS nf, count(*) FILTER (NOT own AND free) AS mf_, count(DISTINCT cluster) FILTER (own) AS n_clusters, count(*) FILTER (own AND abs(er) > 25) AS n_clipped,
    CAST(count(*) FILTER (own AND won) AS DOUBLE) AS w, CAST(count(*) FILTER (NOT own AND won) AS DOUBLE) AS ow, CAST(count(*) FILTER (own AND free AND won) AS DOUBLE) AS fw, CAST(count(*) FILTER (NOT own AND free AND won) AS DOUBLE) AS fow, avg(x) FILTER (own AND free) AS fm, stddev_samp(x) FILTER (own AND free) AS fs,
    avg(x) FILTER (own) AS mean_r, quantile_cont(x, 0.5) FILTER (own) AS median_r, stddev_samp(x) FILTER (own) AS sd_r, coalesce(avg(x) FILTER (NOT own), 0) AS base_mean_r, coalesce(quantile_cont(x, 0.5) FILTER (NOT own), 0) AS base_median_r,
    quantile_cont(mf, 0.5) FILTER (own) AS mfe_r_median, quantile_cont(ma, 0.5) FILTER (own) AS mae_r_median, quantile_cont(ma, 0.9) FILTER (own) AS mae_r_p90 FROM e1 GROUP BY 1, 2),
hh AS (SELECT gg.*, n_dropped_atr, w / n AS p FROM gg JOIN dr ON dr.kind = gg.pattern AND dr.direction = gg.direction WHERE n >= 30)
SELECT pattern, direction, n, nf AS n_independent, n_clusters, n_dropped_atr, n_clipped, round(p, 6) AS share,
    round(greatest(0.0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS share_low,
    round(least(1.0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS share_high,
    round(ow / nullif(m, 0), 6) AS base_share, round(p - ow / nullif(m, 0), 6) AS share_edge, round({_Z.format(x1="w", n1="n", x2="ow", n2="m")}, 6) AS share_z_overlapping,
    round(CASE WHEN nf >= 30 AND mf_ >= 30 THEN {_Z.format(x1="fw", n1="nf", x2="fow", n2="mf_")} ELSE 0.0 END, 6) AS share_z, round(CASE WHEN nf >= 2 AND fs > 0 THEN (fm - base_mean_r) / (fs / sqrt(nf)) ELSE 0.0 END, 6) AS t,
    round(mean_r, 6) AS mean_r, round(median_r, 6) AS median_r, round(sd_r, 6) AS sd_r, round(base_mean_r, 6) AS base_mean_r, round(base_median_r, 6) AS base_median_r, round(mean_r - base_mean_r, 6) AS edge_r, round(median_r - base_median_r, 6) AS median_edge_r,
    round(mfe_r_median, 6) AS mfe_r_median, round(mae_r_median, 6) AS mae_r_median, round(mae_r_p90, 6) AS mae_r_p90, round(CASE WHEN n >= 2 AND sd_r > 0 THEN (mean_r - base_mean_r) / (sd_r / sqrt(n)) ELSE 0.0 END, 6) AS t_overlapping,
    concat_ws(',', CASE WHEN n < 200 THEN 'small_sample' END, CASE WHEN nf < 30 THEN 'few_independent' END, CASE WHEN abs(mean_r - median_r) > 0.5 THEN 'heavy_tails' END, CASE WHEN n_dropped_atr > 0.02 * (n + n_dropped_atr) THEN 'many_dropped' END) AS hints FROM hh"""

SIGNALS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, chg AS (SELECT *, close - lag(close) OVER (PARTITION BY instrument ORDER BY i) AS d FROM bars),
updown AS (SELECT instrument, i, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM chg), {sql.ewm("gain", "updown", "u", "(1.0/14)", 14)}, {sql.ewm("loss", "updown", "dn", "(1.0/14)", 14)},
s AS (SELECT *, {sql.SESSION} AS session, (high + low + close) / 3 AS tp, {sql.LOCAL.format(ts="ts")} AS ny FROM bars),
v AS (SELECT s.*, CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY instrument ORDER BY i ROWS 19 PRECEDING) END AS sma20, coalesce(sum(tp * volume) OVER w / nullif(sum(volume) OVER w, 0), tp) AS vwap FROM s WINDOW w AS (PARTITION BY instrument, session ORDER BY i)),
x AS (SELECT v.*, atr.y AS atr, CASE WHEN loss.y IS NULL THEN NULL WHEN gain.y = 0 THEN 0.0 WHEN loss.y = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain.y / loss.y) END AS rsi, hour(ny) * 60 + minute(ny) AS m
    FROM v LEFT JOIN atr USING (instrument, i) LEFT JOIN gain USING (instrument, i) LEFT JOIN loss USING (instrument, i)),
y AS (SELECT *, lag(close) OVER o AS pc, lag(sma20) OVER o AS ps, lag(vwap) OVER o AS pv, lag(atr) OVER o AS pa FROM x WINDOW o AS (PARTITION BY instrument ORDER BY i)),
f AS (SELECT *, 'cross_up' AS name, CAST(1 AS BIGINT) AS direction FROM y WHERE pc <= ps AND close > sma20 AND close > vwap
    UNION ALL SELECT *, 'cross_down', -1 FROM y WHERE pc >= ps AND close < sma20 AND close < vwap
    UNION ALL SELECT *, 'oversold', 1 FROM y WHERE rsi < 40 AND close > pc AND NOT (m >= 960 AND m <= 1080)
    UNION ALL SELECT *, 'reversion', -1 FROM y WHERE pa > 0 AND abs(pc - pv) > pa AND close < pc)
SELECT instrument, i, name, direction, close AS entry, round(close - direction * 1.5 * atr, 6) AS stop, round(close + direction * 3.0 * atr, 6) AS target FROM f WHERE atr > 0"""

METRICS = f"""WITH {TRADES},
e AS (SELECT *, sum(pnl) OVER w AS equity, count(*) FILTER (pnl > 0) OVER w AS island FROM tr WINDOW w AS (PARTITION BY strategy ORDER BY ts, k ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY strategy ORDER BY ts, k ROWS UNBOUNDED PRECEDING)) AS peak FROM e),
s AS (SELECT strategy, max(c) AS losing_streak FROM (SELECT strategy, island, count(*) AS c FROM p WHERE pnl <= 0 GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT strategy, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gp, sum(CASE WHEN pnl > 0 THEN 0 ELSE -pnl END) AS gl, avg(pnl) AS mean, max(peak - equity) AS dd FROM p GROUP BY 1)
SELECT strategy, n, wins, round(gp, 6) AS gross_profit, round(gl, 6) AS gross_loss, round(mean, 6) AS mean, round(dd, 6) AS drawdown, coalesce(losing_streak, 0) AS losing_streak, round(gp / nullif(gl, 0), 6) AS profit_factor FROM g LEFT JOIN s USING (strategy)"""

QUERIES = {
    "forward_outcomes": forward_outcomes,
    "barrier_grid": barrier_grid,
    "base_rates": base_rates,
    "base_rates_by_variant": base_rates_by_variant,
    "event_clusters": event_clusters,
    "event_counts": event_counts,
    "event_look_ahead": event_look_ahead,
    "non_overlapping": non_overlapping,
    "level_interactions": lambda s, d: ev.level_interactions(levels_long(hourly(s, d), ticks(s, d))),
    "rule_signals": rule_signals,
    "backtest": backtest,
    "trade_metrics": trade_metrics,
    "daily_sharpe": daily_sharpe,
    "factor_test": factor_test,
    "three_way_split": lambda s, d: bt.split(hourly(s, d)).groupBy("instrument", "split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
    "walk_forward": walk_forward,
    "account_replay": lambda s, d: bt.account_replay(_trades(s, d), "strategy", 50000.0, 500.0, 1000.0, 2500.0),
}
ORACLES = {
    "forward_outcomes": OUTCOMES,
    "barrier_grid": BARRIERS,
    "base_rates": RATES,
    "base_rates_by_variant": RATES.replace("pattern AS kind, instrument ||", "concat_ws('/', pattern, variant) AS kind, instrument ||").replace("\nSELECT pattern, direction, n, nf", "\nSELECT split_part(pattern, '/', 1) AS pattern, split_part(pattern, '/', 2) AS variant, direction, n, nf"),
    "event_clusters": f"WITH RECURSIVE {sql.BARS}, {EVENTS}, {CLUSTERS_CTE} SELECT * FROM cls",
    "event_counts": f"WITH RECURSIVE {sql.BARS}, {EVENTS} SELECT pattern, variant, direction, count(*) AS n FROM evs GROUP BY 1, 2, 3",
    "event_look_ahead": f"WITH RECURSIVE {sql.BARS}, {EVENTS} SELECT pattern, count(*) AS n, count(*) FILTER (origin > i OR origin < 0 OR i > last_i) AS early FROM evs JOIN (SELECT instrument, max(i) AS last_i FROM bars GROUP BY 1) USING (instrument) GROUP BY 1",
    "level_interactions": f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {sql.TICKS}, {LAST}, {LEVELS_CTE}, {INTERACTIONS_CTE} SELECT * FROM lint",
    "non_overlapping": f"""WITH RECURSIVE {sql.BARS}, {EVENTS},
nr AS (SELECT instrument, pattern, direction, min(i) AS i FROM evs GROUP BY 1, 2, 3 UNION ALL SELECT * FROM (SELECT e.instrument, e.pattern, e.direction, min(e.i) AS i FROM nr JOIN evs e ON e.instrument = nr.instrument AND e.pattern = nr.pattern AND e.direction = nr.direction AND e.i >= nr.i + 10 GROUP BY 1, 2, 3))
SELECT * FROM nr""",
    "rule_signals": SIGNALS,
    "trade_metrics": METRICS,
    "daily_sharpe": f"WITH {TRADES}, d AS (SELECT strategy, CAST(ts AS DATE) AS day, sum(pnl) AS pnl FROM tr GROUP BY 1, 2), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY day) > 1) SELECT strategy, count(*) AS days, round(sqrt(252.0) * avg(pnl) / nullif(stddev_samp(pnl), 0), 6) AS sharpe FROM c GROUP BY 1",
    "factor_test": f"WITH {TRADES} SELECT isodow(ts) - 1 AS weekday, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS won, round(avg(pnl), 6) AS mean, round(stddev_samp(pnl), 6) AS sd, round(avg(pnl) / nullif(stddev_samp(pnl) / sqrt(count(*)), 0), 6) AS t FROM tr GROUP BY 1",
    "three_way_split": f"WITH {sql.BARS}, s AS (SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'oos' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY instrument) AS n FROM bars)) SELECT instrument, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2",
    "walk_forward": f"WITH {sql.BARS}, z AS (SELECT instrument, unnest(range(0, count(*) - 299, 100)) AS start FROM bars GROUP BY instrument) SELECT z.instrument, start, CASE WHEN b.i < start + 200 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(close - open), 6) AS net FROM z JOIN bars b ON b.instrument = z.instrument AND b.i BETWEEN start AND start + 299 GROUP BY 1, 2, 3",
}
