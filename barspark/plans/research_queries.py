"""Research queries, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import backtest as bt
from barspark.operators import costs as co
from barspark.operators import research as rs
from barspark.plans import sql
from barspark.plans.event_queries import TRADES, _rule_bars, _trades
from barspark.plans.structure_queries import EQUAL_CTE, SWINGS
from barspark.sources.bars import hourly, ticks


def _rounded(rows, *columns):
    for c in columns:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


def contract_expiries(spark, sf_dir):
    months = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return months.select("month", rs.third_friday(F.col("month")).alias("third_friday"), rs.third_last_business_day(F.col("month")).alias("third_last_business_day"))


def _vintages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("available_at"), F.col("o_totalprice").alias("actual"))


def blackouts(spark, sf_dir):
    releases = ticks(spark, sf_dir).filter("instrument = 'error'").select(F.col("ts").alias("at"))
    return rs.blackouts(hourly(spark, sf_dir), releases, 30, 15)


def paired_fills(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fills = rows.select(F.col("l_orderkey").alias("order_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").alias("k"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("side"))
    return _rounded(rs.paired_fills(fills), "points")


def ladder(spark, sf_dir):
    rows = _trades(spark, sf_dir).withColumn("quartile", (F.col("k") % 4).cast("long")).withColumn("year", F.year("ts").cast("long")).withColumn("won", F.col("pnl") > 0)
    return _rounded(rs.ladder(rows), "won")


def sampled(spark, sf_dir):
    return rs.sampled_by_month(_trades(spark, sf_dir).select("k", "ts"), "ts", 3, F.md5(F.col("k").cast("string")))


def data_hash(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rs.data_hash(rows, F.to_date("o_orderdate"), F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")))


def factor_significance(spark, sf_dir):
    tested = bt.factor_test(_trades(spark, sf_dir).withColumn("weekday", F.weekday("ts").cast("long")), "weekday")
    return _rounded(rs.with_p_values(tested).select("weekday", "n", "t", "p", "significant"), "t", "p")


RSI = """chg AS (SELECT *, close - lag(close) OVER (PARTITION BY instrument ORDER BY i) AS d FROM bars),
updown AS (SELECT instrument, i, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM chg),""" + sql.ewm("gain", "updown", "u", "(1.0/14)", 14) + "," + sql.ewm("loss", "updown", "dn", "(1.0/14)", 14) + """,
rsi AS (SELECT instrument, i, CASE WHEN loss.y IS NULL THEN NULL WHEN gain.y = 0 THEN 0.0 WHEN loss.y = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain.y / loss.y) END AS rsi FROM bars LEFT JOIN gain USING (instrument, i) LEFT JOIN loss USING (instrument, i))"""

DIVERGENCE = f"""WITH RECURSIVE {sql.BARS}, {RSI}, {SWINGS},
p AS (SELECT s.*, rsi, lag(price) OVER w AS p0, lag(rsi) OVER w AS r0 FROM swings s JOIN rsi USING (instrument, i) WINDOW w AS (PARTITION BY instrument, kind ORDER BY i))
SELECT instrument, i, available, CAST(CASE WHEN kind = 'low' THEN 1 ELSE -1 END AS BIGINT) AS direction, round(rsi - r0, 6) AS gap FROM p WHERE (kind = 'high' AND price > p0 AND rsi < r0 - 2) OR (kind = 'low' AND price < p0 AND rsi > r0 + 2)"""

CANDLES = f"""WITH {sql.BARS}, x AS (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS up, least(open, close) - low AS lo FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i)),
c AS (SELECT instrument, i, CASE WHEN pc < po AND close > open AND open <= pc AND close >= po THEN 'bullish_engulfing' WHEN pc > po AND close < open AND open >= pc AND close <= po THEN 'bearish_engulfing'
    WHEN span > 0 AND lo >= 2 * body AND lo >= 0.5 * span THEN 'bullish_pin' WHEN span > 0 AND up >= 2 * body AND up >= 0.5 * span THEN 'bearish_pin' END AS candle FROM x)
SELECT * FROM c WHERE candle IS NOT NULL"""

NEAREST = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, s AS (SELECT *, {sql.SESSION} AS session FROM bars),
days AS (SELECT instrument, session, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM s GROUP BY ALL),
pv AS (SELECT instrument, session, lag(h) OVER w AS prev_high, lag(l) OVER w AS prev_low, lag(c) OVER w AS prev_close FROM days WINDOW w AS (PARTITION BY instrument ORDER BY session)),
x AS (SELECT s.instrument, s.i, s.ts, s.close, atr.y AS atr, prev_high, prev_low, prev_close, max(high) OVER w AS day_high, min(low) OVER w AS day_low FROM s JOIN pv USING (instrument, session) JOIN atr USING (instrument, i) WINDOW w AS (PARTITION BY s.instrument, session ORDER BY s.i)),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) = 1),
u AS (SELECT instrument, close, atr, unnest(['prev_high', 'prev_low', 'prev_close', 'day_high', 'day_low']) AS name, unnest([prev_high, prev_low, prev_close, day_high, day_low]) AS level FROM l)
SELECT instrument, row_number() OVER w AS rank, name, level, round(level - close, 6) AS points, round((level - close) / nullif(atr, 0), 6) AS in_atr FROM u WHERE level IS NOT NULL WINDOW w AS (PARTITION BY instrument ORDER BY abs(level - close), name) QUALIFY row_number() OVER w <= 3"""

BLACKOUT = f"""WITH {sql.BARS}, r AS (SELECT DISTINCT ts AS rel FROM events WHERE event_type = 'error'), x AS (SELECT *, ts - INTERVAL 15 MINUTE AS since FROM bars),
n AS (SELECT x.*, rel AS next_release FROM x ASOF LEFT JOIN r ON x.ts <= r.rel), f AS (SELECT n.*, r.rel AS nearest FROM n ASOF LEFT JOIN r ON n.since <= r.rel)
SELECT instrument, i, coalesce(nearest <= ts + INTERVAL 30 MINUTE, false) AS blackout, next_release FROM f"""

QUERIES = {
    "contract_expiries": contract_expiries,
    "session_delta": lambda s, d: rs.session_delta(ticks(s, d), F.col("user_id") % 2 == 0),
    "rsi_divergence": lambda s, d: _rounded(rs.rsi_divergence(hourly(s, d)), "gap"),
    "candles": lambda s, d: rs.candles(hourly(s, d)),
    "equal_extremes": lambda s, d: _rounded(rs.equal_extremes(hourly(s, d)), "level"),
    "nearest_levels": lambda s, d: _rounded(rs.nearest_levels(hourly(s, d)), "points", "in_atr"),
    "vintages": lambda s, d: rs.vintages(_vintages(s, d), ["series"], "available_at"),
    "known_at": lambda s, d: rs.known_at(_vintages(s, d), ["series"], "available_at", F.to_timestamp_ntz(F.lit("1996-06-30"))),
    "blackouts": blackouts,
    "paired_fills": paired_fills,
    "cost_sources": lambda s, d: _rounded(co.by_profile(co.net_of_costs(_trades(s, d).withColumn("points", F.col("pnl"))), "strategy"), "gross", "commission", "slippage", "net", "won", "cost_a_trade", "kept"),
    "cost_profiles": lambda s, d: _rounded(rs.under_costs(_trades(s, d), "strategy"), "net", "won"),
    "in_sample_ratio": lambda s, d: _rounded(rs.in_sample_ratio(_trades(s, d), "strategy", F.to_timestamp_ntz(F.lit("1996-01-01"))), "inside", "outside", "robustness"),
    "best_day_share": lambda s, d: _rounded(rs.best_day_share(_trades(s, d), "strategy"), "best", "gained", "share"),
    "quantile_factor": lambda s, d: _rounded(bt.factor_test(rs.quantile_factor(_trades(s, d), "risk"), "bucket"), "won", "mean", "sd", "t"),
    "conditional_outcomes": lambda s, d: _rounded(rs.conditional(_rule_bars(s, d), F.col("rsi") < 40, 5), "mean", "sd", "won", "all_mean", "all_won", "edge"),
    "measurement_ladder": ladder,
    "sampled_by_month": sampled,
    "data_hash": data_hash,
    "factor_significance": factor_significance,
}
ORACLES = {
    "contract_expiries": """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), d AS (SELECT month, CAST(unnest(generate_series(month, month + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM m),
f AS (SELECT month, d AS third_friday FROM d WHERE isodow(d) = 5 QUALIFY row_number() OVER (PARTITION BY month ORDER BY d) = 3), b AS (SELECT month, d AS third_last_business_day FROM d WHERE isodow(d) <= 5 QUALIFY row_number() OVER (PARTITION BY month ORDER BY d DESC) = 3)
SELECT * FROM f JOIN b USING (month)""",
    "session_delta": f"WITH h AS (SELECT event_type AS instrument, {sql.SESSION} AS session, date_trunc('hour', ts) AS hour, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS delta, count(*) AS flow FROM events GROUP BY 1, 2, 3) SELECT *, CAST(sum(delta) OVER (PARTITION BY instrument, session ORDER BY hour) AS BIGINT) AS cum_delta FROM h",
    "rsi_divergence": DIVERGENCE,
    "candles": CANDLES,
    "equal_extremes": f"WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS}, {EQUAL_CTE} SELECT * REPLACE (round(level, 6) AS level) FROM eq",
    "nearest_levels": NEAREST,
    "vintages": "SELECT o_custkey AS series, o_orderkey AS id, o_orderdate AS available_at, o_totalprice AS actual, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders",
    "known_at": "SELECT o_custkey AS series, o_orderkey AS id, o_orderdate AS available_at, o_totalprice AS actual FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "blackouts": BLACKOUT,
    "paired_fills": "WITH f AS (SELECT l_orderkey AS order_id, count(*) AS fills, arg_min(l_extendedprice, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)) AS entry, arg_max(l_extendedprice, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)) AS exit, arg_min(l_quantity, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)) AS qty, arg_min(l_returnflag, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)) AS side FROM lineitem GROUP BY 1 HAVING count(*) > 1) SELECT *, round(CASE WHEN side = 'A' THEN -1 ELSE 1 END * (exit - entry), 6) AS points FROM f",
    "cost_sources": f"""WITH {TRADES}, p AS (SELECT unnest([{", ".join(f"{{'profile': '{p.name}', 'c': CAST({p.round_turn} AS DOUBLE), 's': CAST({2 * p.slippage_ticks * 0.25 * 2.0} AS DOUBLE)}}" for p in co.PROFILES)}], recursive := true)),
x AS (SELECT strategy, profile, 2.0 * pnl AS gross, c AS commission, s AS slippage, 2.0 * pnl - c - s AS net FROM tr, p), g AS (SELECT strategy, profile, count(*) AS n, sum(gross) AS gross, sum(commission) AS commission, sum(slippage) AS slippage, sum(net) AS net, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS won FROM x GROUP BY ALL)
SELECT strategy, profile, n, round(gross, 6) AS gross, round(commission, 6) AS commission, round(slippage, 6) AS slippage, round(net, 6) AS net, round(won, 6) AS won, round((commission + slippage) / n, 6) AS cost_a_trade, round(CASE WHEN gross > 0 THEN net / gross END, 6) AS kept FROM g""",
    "cost_profiles": f"WITH {TRADES}, p AS (SELECT unnest(['none', 'retail', 'stressed']) AS profile, unnest([0.0, 1.25, 1.25]) AS c, unnest([0.0, 1.0, 3.0]) AS s) SELECT strategy, profile, count(*) AS n, round(sum(pnl - 2 * CAST(c AS DOUBLE) - 2 * CAST(s AS DOUBLE) * 0.25), 6) AS net, round(avg(CASE WHEN pnl - 2 * CAST(c AS DOUBLE) - 2 * CAST(s AS DOUBLE) * 0.25 > 0 THEN 1.0 ELSE 0.0 END), 6) AS won FROM tr CROSS JOIN p GROUP BY 1, 2",
    "in_sample_ratio": f"WITH {TRADES}, g AS (SELECT strategy, avg(pnl) FILTER (ts < TIMESTAMP '1996-01-01') AS a, avg(pnl) FILTER (ts >= TIMESTAMP '1996-01-01') AS b FROM tr GROUP BY 1) SELECT strategy, round(a, 6) AS inside, round(b, 6) AS outside, round(CASE WHEN a > 0 THEN b / a END, 6) AS robustness FROM g",
    "best_day_share": f"WITH {TRADES}, d AS (SELECT strategy, CAST(ts AS DATE) AS day, sum(pnl) AS pnl FROM tr GROUP BY 1, 2), g AS (SELECT strategy, count(*) AS days, max(pnl) AS best, sum(greatest(0.0, pnl)) AS gained FROM d GROUP BY 1) SELECT strategy, days, round(best, 6) AS best, round(gained, 6) AS gained, round(CASE WHEN best > 0 THEN best / gained END, 6) AS share FROM g",
    "quantile_factor": f"WITH {TRADES}, b AS (SELECT quantile_cont(risk, [0.25, 0.5, 0.75]) AS q FROM tr), x AS (SELECT tr.*, CAST(len(list_filter(q, lambda v: v <= risk)) AS BIGINT) AS bucket FROM tr CROSS JOIN b) SELECT bucket, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS won, round(avg(pnl), 6) AS mean, round(stddev_samp(pnl), 6) AS sd, round(avg(pnl) / nullif(stddev_samp(pnl) / sqrt(count(*)), 0), 6) AS t FROM x GROUP BY 1",
    "conditional_outcomes": f"WITH RECURSIVE {sql.BARS}, {RSI}, x AS (SELECT instrument, coalesce(rsi < 40, false) AS hit, lead(close, 5) OVER w - lead(open) OVER w AS e FROM bars JOIN rsi USING (instrument, i) WINDOW w AS (PARTITION BY instrument ORDER BY i)), g AS (SELECT instrument, count(*) FILTER (hit) AS n, avg(e) FILTER (hit) AS m, stddev_pop(e) FILTER (hit) AS sd, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END) FILTER (hit) AS won, avg(e) AS am, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END) AS aw FROM x WHERE e IS NOT NULL GROUP BY 1) SELECT instrument, n, round(m, 6) AS mean, round(sd, 6) AS sd, round(won, 6) AS won, round(am, 6) AS all_mean, round(aw, 6) AS all_won, round(m - am, 6) AS edge FROM g",
    "measurement_ladder": f"WITH {TRADES}, x AS (SELECT k % 4 AS quartile, year(ts) AS year, pnl > 0 AS won FROM tr) SELECT quartile, year, count(*) AS n, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS won FROM x GROUP BY GROUPING SETS ((), (quartile), (year))",
    "sampled_by_month": f"WITH {TRADES} SELECT k, ts, date_trunc('month', ts) AS month FROM tr QUALIFY row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY md5(CAST(k AS VARCHAR))) <= 3",
    "data_hash": "WITH p AS (SELECT CAST(o_orderdate AS DATE) AS day, l[1:2] AS part, sha256(string_agg(l, chr(10) ORDER BY l)) AS h FROM (SELECT o_orderdate, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS l FROM orders) GROUP BY 1, 2), d AS (SELECT day, sha256(string_agg(h, chr(10) ORDER BY part)) AS h FROM p GROUP BY 1) SELECT count(*) AS days, sha256(string_agg(h, chr(10) ORDER BY day)) AS hash FROM d",
}
