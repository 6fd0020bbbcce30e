"""Day levels, history measures, trade summaries, factors, conditions and comparisons, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import backtest as bt
from barspark.operators import day_levels as dl
from barspark.operators import events as ev
from barspark.operators import measure as me
from barspark.operators import strategies as sg
from barspark.operators import validation as va
from barspark.operators.indicators import atr, rsi
from barspark.operators.structure import double_patterns
from barspark.plans import sql
from barspark.plans.event_queries import AHEAD_CTE, BARRIERS, EVENTS, TRADES, _detected, _trades
from barspark.plans.research_queries import RSI
from barspark.plans.strategy_queries import PREPARED_CTE, _entries, _prepared
from barspark.plans.structure_queries import DOUBLES_CTE, SWINGS
from barspark.sources.bars import hourly, ticks


def _rounded(rows, *columns):
    for c in columns or [c for c, t in rows.dtypes if t == "double"]:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


def trade_summary(spark, sf_dir):
    trades = _trades(spark, sf_dir).withColumn("bars_held", F.col("risk"))
    return _rounded(va.trade_summary(trades, "strategy", ["ts", "k"], 1e6, 50_000.0))


def factor_table(spark, sf_dir):
    """Entries of the VWAP trend strategy by what was known at their bar, with the ends after ten bars in their favour."""
    rows = _prepared(spark, sf_dir)
    found = sg.entries(rows, [sg.build("vwap_trend")]).select("instrument", "ts", "i", "direction", "entry")
    ends = ev.outcomes(found.select("instrument", "i", "direction"), hourly(spark, sf_dir), (10,)).select("instrument", "i", "direction", F.col("end_points").alias("pnl"))
    at = me.at_bar(found.join(ends, ["instrument", "i", "direction"]), rows, ["rsi", "vwap", "ib_high", "ib_low", "plus_di", "minus_di", "flag_direction"])
    c = F.col
    factors = {
        "hour": va.hour_bucket(c("ts")), "weekday": va.weekday(c("ts")), "rsi": va.bounded(c("rsi"), [40.0, 50.0, 60.0], ["low", "lower", "upper", "high"]), "vwap": va.relation(c("entry"), c("vwap")),
        "ib": va.location(c("entry"), c("ib_low"), c("ib_high")), "di": va.sign(c("plus_di") - c("minus_di")), "flag": va.category(c("flag_direction"), {-1: "down", 0: "none", 1: "up"}), "long": va.yes_no(c("direction") == 1),
    }
    return _rounded(va.factor_table(at, factors))


def walk_forward_report(spark, sf_dir):
    rows = bt.walk_forward(hourly(spark, sf_dir), 50, 25, 25)
    windows = rows.groupBy("instrument", "start", "part").agg(F.sum(F.col("close") - F.col("open")).alias("net"))
    return _rounded(va.walk_forward_report(windows, "instrument"))


def parameter_search(spark, sf_dir):
    """Stops and targets in ATR for all events, by mean result per event; each pair is a run over the training part of the series."""
    training = bt.split(hourly(spark, sf_dir)).filter("split = 'train'").select("instrument", "i")
    touches = ev.first_touches(_detected(spark, sf_dir), hourly(spark, sf_dir)).join(training, ["instrument", "i"])
    runs = touches.select("instrument", "i", "direction", "pattern", F.col("multiple").alias("target"), "target_at").dropDuplicates(["instrument", "i", "direction", "pattern", "target"])
    stops = touches.select("instrument", "i", "direction", "pattern", F.col("multiple").alias("stop"), "stop_at").dropDuplicates(["instrument", "i", "direction", "pattern", "stop"])
    both = runs.join(stops, ["instrument", "i", "direction", "pattern"])
    won = F.col("target_at").isNotNull() & (F.col("stop_at").isNull() | (F.col("target_at") < F.col("stop_at")))
    lost = F.col("stop_at").isNotNull() & ~won
    both = both.withColumn("pnl", F.when(won, F.col("target")).when(lost, -F.col("stop")).otherwise(0.0))
    wanted = {(x["target"], x["stop"]) for x in va.grid(target=list(ev.MULTIPLES), stop=list(ev.MULTIPLES))}
    assert len(wanted) == 25
    return _rounded(va.searched(both, ["target", "stop"], F.round(F.avg("pnl"), 9), 30), "objective")


def condition_table(spark, sf_dir):
    rows = rsi(atr(hourly(spark, sf_dir)))
    c = F.col
    named = {"oversold": (c("rsi") < 40, 1), "overbought": (c("rsi") > 60, -1), "wide_bar": (c("high") - c("low") > 1.5 * c("atr"), 1), "narrow_bar": (c("high") - c("low") < 0.5 * c("atr"), -1)}
    return _rounded(me.conditions(rows, named, 5))


def overlapping_doubles(spark, sf_dir):
    """Double bottoms that cover more than half of a double top's span."""
    rows = double_patterns(hourly(spark, sf_dir)).select(F.concat_ws("/", "instrument", "pattern", "i").alias("id"), "instrument", "pattern", F.col("first_i").alias("first_i"), F.col("i").alias("last_i"))
    span = lambda p: rows.filter(F.col("pattern") == p).drop("pattern")
    return me.overlapping(span("double_top"), span("double_bottom"))


def not_judged(spark, sf_dir):
    """Orders without a returned line."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return me.not_judged(orders, lines, ["k"])


def event_json(spark, sf_dir):
    found = _detected(spark, sf_dir).select("instrument", "i", "direction", "pattern", "variant")
    return me.as_json(found, ["instrument", "i"]).select("instrument", "i", "features", F.get_json_object("features", "$.pattern").alias("pattern"))


DAY_LEVELS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {sql.TICKS},
z AS (SELECT *, CAST(lts AS DATE) = session AS today, hour(timezone('Asia/Tokyo', timezone('UTC', ts))) * 60 + minute(timezone('Asia/Tokyo', timezone('UTC', ts))) AS tk, hour(timezone('Europe/London', timezone('UTC', ts))) * 60 + minute(timezone('Europe/London', timezone('UTC', ts))) AS ld FROM t),
d AS (SELECT instrument, session, max(price) AS day_high, min(price) AS day_low, arg_max(price, row(ts, event_id)) AS now, max(price) FILTER (tk >= 540 AND tk < 1080) AS asia_high, min(price) FILTER (tk >= 540 AND tk < 1080) AS asia_low, max(price) FILTER (ld >= 480 AND ld < 990) AS london_high, min(price) FILTER (ld >= 480 AND ld < 990) AS london_low,
    max(price) FILTER (m < 570 OR m >= 1080) AS overnight_high, min(price) FILTER (m < 570 OR m >= 1080) AS overnight_low, {", ".join(f"max(price) FILTER (today AND m BETWEEN 570 AND {569 + k}) AS {n}_high, min(price) FILTER (today AND m BETWEEN 570 AND {569 + k}) AS {n}_low" for n, k in (("ib", 60), ("or5", 5), ("or15", 15), ("or30", 30)))},
    arg_min(price, row(ts, event_id)) FILTER (today AND m BETWEEN 570 AND 959) AS cash_open FROM z GROUP BY 1, 2),
e AS (SELECT *, lag(day_high) OVER w AS prev_day_high, lag(day_low) OVER w AS prev_day_low, lag(now) OVER w AS prev_day_close FROM d WINDOW w AS (PARTITION BY instrument ORDER BY session)),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY session DESC) = 1), u AS (SELECT instrument, arg_max(atr.y, i) AS a FROM atr GROUP BY 1),
x AS (SELECT l.instrument, session, now, a, unnest([{", ".join(f"'{n}'" for n in dl.NAMES)}]) AS name, unnest([{", ".join(dl.NAMES)}]) AS price, unnest([{", ".join(f"'{w}'" for w in dl.NAMES.values())}]) AS why FROM l JOIN u USING (instrument))
SELECT instrument, session, name, price, round(price - now, 6) AS points, round((price - now) / 0.25, 6) AS in_ticks, round((price - now) / nullif(a, 0), 6) AS in_atr, CASE WHEN price IS NULL THEN why END AS missing FROM x"""

HISTORY = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR},
h AS (SELECT b.*, atr.y AS a, {sql.SESSION} AS session FROM bars b JOIN atr USING (instrument, i)),
h1 AS (SELECT *, dense_rank() OVER (PARTITION BY instrument ORDER BY session DESC) - 1 AS age, epoch(ts - min(ts) OVER (PARTITION BY instrument, session)) / 60 AS elapsed, hour(ts) * 60 + minute(ts) AS clock FROM h),
n AS (SELECT instrument, max(elapsed) AS ne, arg_max(clock, ts) AS nc, arg_max(a, ts) AS na FROM h1 WHERE age = 0 GROUP BY 1),
s AS (SELECT instrument, age, na, max(high) AS high, min(low) AS low, sum(volume) FILTER (elapsed <= ne) AS vol, avg(a) FILTER (least(abs(clock - nc), 1440 - abs(clock - nc)) <= 15) AS a FROM h1 JOIN n USING (instrument) WHERE age <= 20 GROUP BY 1, 2, 3),
g AS (SELECT instrument, CAST(max(age) AS BIGINT) AS complete, max(high) FILTER (age <= 5) AS week_high, min(low) FILTER (age <= 5) AS week_low, max(vol) FILTER (age = 0) / nullif(avg(vol) FILTER (age BETWEEN 1 AND 10), 0) AS relative_volume,
    CASE WHEN count(a) FILTER (age >= 1) >= 3 THEN count(*) FILTER (age >= 1 AND a < na) / count(a) FILTER (age >= 1) END AS atr_percentile FROM s GROUP BY 1),
x AS (SELECT instrument, complete, unnest(['week_high', 'week_low', 'relative_volume', 'atr_percentile']) AS name, unnest([week_high, week_low, relative_volume, atr_percentile]) AS v, CAST(unnest([5, 5, 10, 20]) AS BIGINT) AS required FROM g)
SELECT instrument, name, round(CASE WHEN complete >= required THEN v END, 6) AS value, complete AS sessions_available, required AS sessions_required FROM x"""

SUMMARY = f"""WITH {TRADES},
e AS (SELECT *, sum(pnl) OVER w AS equity, count(*) FILTER (pnl > 0) OVER w AS island, row_number() OVER w AS n FROM tr WINDOW w AS (PARTITION BY strategy ORDER BY ts, k)),
p AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY ts, k) AS peak FROM e), q AS (SELECT *, peak - equity AS down FROM p),
s AS (SELECT strategy, max(c) AS streak FROM (SELECT strategy, island, count(*) AS c FROM q WHERE pnl <= 0 GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT strategy, CAST(ts AS DATE) AS day, sum(pnl) AS change FROM tr GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY day) > 1),
ds AS (SELECT strategy, count(*) AS days, sqrt(252.0) * avg(change) / nullif(stddev_samp(change), 0) AS sharpe FROM d GROUP BY 1),
g AS (SELECT strategy, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, sum(pnl) AS total, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)) AS lost, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS aw, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS al, avg(pnl) AS at_,
    coalesce(max(pnl) FILTER (pnl > 0), 0) AS lw_, coalesce(min(pnl) FILTER (pnl <= 0), 0) AS ll_, max(down) AS dd, arg_max(peak, row(down, -n)) AS pk, avg(risk) AS held, sum(risk) / 1e6 * 100 AS exposure FROM q GROUP BY 1)
SELECT strategy, trades, wins, losses, round(wins / trades, 6) AS win_rate, round(total, 6) AS total_pnl, round(CASE WHEN lost > 0 THEN gain / lost WHEN gain > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS profit_factor, round(wins / trades * aw + (1 - wins / trades) * al, 6) AS expectancy, round(aw, 6) AS avg_win, round(al, 6) AS avg_loss, round(at_, 6) AS avg_trade,
    round(lw_, 6) AS largest_win, round(ll_, 6) AS largest_loss, round(dd, 6) AS max_drawdown, round(CASE WHEN pk > 0 THEN dd / pk END, 6) AS max_drawdown_pct, coalesce(streak, 0) AS max_consecutive_losses, round(held, 6) AS avg_bars_held, round(exposure, 6) AS exposure_pct, round(sharpe, 6) AS sharpe_pnl, round(sharpe, 6) AS sharpe_on_capital, coalesce(days, 0) AS trading_days
FROM g LEFT JOIN s USING (strategy) LEFT JOIN ds USING (strategy)"""

FACTORS = f"""WITH RECURSIVE {sql.BARS}, {PREPARED_CTE}, {AHEAD_CTE}, en AS ({_entries(["vwap_trend"])}),
fa AS (SELECT en.direction, en.entry, en.ts, {sql.LOCAL.format(ts="en.ts")} AS ny, en.direction * (cs[10] - ah.entry) AS pnl, rsi, vwap, ib_high, ib_low, pd, md, flag_direction FROM en JOIN ah USING (instrument, i) JOIN spx USING (instrument, i) JOIN di USING (instrument, i) JOIN flz USING (instrument, i) WHERE len(cs) >= 10),
fb AS (SELECT CASE WHEN pnl = 0 THEN 0.0 ELSE pnl END AS pnl, unnest(['hour', 'weekday', 'rsi', 'vwap', 'ib', 'di', 'flag', 'long']) AS factor, unnest([CASE WHEN hour(ny) IN (9, 10) THEN 'open' WHEN hour(ny) IN (11, 12, 13) THEN 'midday' WHEN hour(ny) IN (14, 15) THEN 'close' ELSE 'outside' END, strftime(ny, '%a'),
    CASE WHEN rsi <= 40 THEN 'low' WHEN rsi <= 50 THEN 'lower' WHEN rsi <= 60 THEN 'upper' WHEN rsi IS NOT NULL THEN 'high' END, CASE WHEN entry > vwap THEN 'above' WHEN entry < vwap THEN 'below' WHEN entry = vwap THEN 'at' END,
    CASE WHEN entry > ib_high THEN 'above' WHEN entry < ib_low THEN 'below' WHEN ib_low IS NOT NULL AND ib_high IS NOT NULL THEN 'inside' END, CASE WHEN pd > md THEN 'positive' WHEN pd < md THEN 'negative' WHEN pd = md THEN 'zero' END, CASE flag_direction WHEN -1 THEN 'down' WHEN 0 THEN 'none' ELSE 'up' END, CASE WHEN direction = 1 THEN 'yes' ELSE 'no' END]) AS bucket FROM fa)
SELECT factor, bucket, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS won, round(avg(pnl), 6) AS mean, round(stddev_samp(pnl), 6) AS sd, round(avg(pnl) / nullif(stddev_samp(pnl) / sqrt(count(*)), 0), 6) AS t FROM fb WHERE bucket IS NOT NULL GROUP BY 1, 2"""

WALK = f"""WITH {sql.BARS}, z AS (SELECT instrument, unnest(range(0, count(*) - 74, 25)) AS start FROM bars GROUP BY instrument),
w AS (SELECT z.instrument, start, sum(close - open) FILTER (b.i < start + 50) AS train, sum(close - open) FILTER (b.i >= start + 50) AS test FROM z JOIN bars b ON b.instrument = z.instrument AND b.i BETWEEN start AND start + 74 GROUP BY 1, 2)
SELECT instrument, count(test) AS tests, round(avg(CASE WHEN test > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, round(sum(test), 6) AS net, round(avg(test) / CASE WHEN avg(train) > 0 THEN avg(train) END, 6) AS test_over_train FROM w GROUP BY 1"""

_GRID = BARRIERS[: BARRIERS.index("bg AS (")]
SEARCH = f"""{_GRID}sr2 AS (SELECT a.multiple AS target, b.multiple AS stop, CASE WHEN a.ta IS NOT NULL AND (b.sa IS NULL OR a.ta < b.sa) THEN a.multiple WHEN b.sa IS NOT NULL THEN -b.multiple ELSE 0.0 END AS pnl FROM bd a JOIN bd b USING (instrument, i, direction, pattern) JOIN (SELECT instrument, count(*) AS size FROM bars GROUP BY 1) USING (instrument) WHERE i < floor(size * 0.6)),
so AS (SELECT target, stop, count(*) AS trades, round(avg(pnl), 9) AS objective FROM sr2 GROUP BY 1, 2)
SELECT target, stop, trades, round(objective, 6) AS objective, trades >= 30 AS enough, row_number() OVER (ORDER BY (trades >= 30) DESC, objective DESC, target, stop) AS rank FROM so"""

CONDITIONS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {RSI},
x AS (SELECT b.*, rsi, atr.y AS a, lead(close, 5) OVER w - lead(open) OVER w AS e FROM bars b JOIN rsi USING (instrument, i) JOIN atr USING (instrument, i) WINDOW w AS (PARTITION BY b.instrument ORDER BY b.i)),
y AS (SELECT e, unnest(['oversold', 'overbought', 'wide_bar', 'narrow_bar']) AS condition, CAST(unnest([1, -1, 1, -1]) AS BIGINT) AS direction, unnest([coalesce(rsi < 40, false), coalesce(rsi > 60, false), coalesce(high - low > 1.5 * a, false), coalesce(high - low < 0.5 * a, false)]) AS hit FROM x WHERE e IS NOT NULL),
z AS (SELECT condition, direction, hit, direction * e AS v FROM y)
SELECT condition, direction, count(*) FILTER (hit) AS n, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) FILTER (hit), 6) AS won, round(avg(v) FILTER (hit), 6) AS mean, round(stddev_samp(v) FILTER (hit), 6) AS sd, round(avg(v), 6) AS all_mean, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS all_won,
    round((avg(v) FILTER (hit) - avg(v)) / nullif(stddev_samp(v) FILTER (hit) / sqrt(count(*) FILTER (hit)), 0), 6) AS t FROM z GROUP BY 1, 2"""

OVERLAPS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {SWINGS}, {DOUBLES_CTE}, o AS (SELECT instrument || '/' || pattern || '/' || i AS id, * FROM dbl)
SELECT a.instrument, a.id, b.id AS other FROM o a JOIN o b ON a.instrument = b.instrument AND a.pattern = 'double_top' AND b.pattern = 'double_bottom' AND least(a.i, b.i) - greatest(a.first_i, b.first_i) + 1 > 0.5 * (a.i - a.first_i + 1)"""

NULL_LINE = _GRID.replace("(SELECT DISTINCT instrument, i, direction, pattern FROM evs) e", "(SELECT instrument, i, CAST(unnest([1, -1]) AS BIGINT) AS direction, 'null_line' AS pattern FROM bars) e") + BARRIERS[BARRIERS.index("bg AS (") :]

QUERIES = {
    "day_levels": lambda s, d: _rounded(dl.day_levels(ticks(s, d), hourly(s, d)), "points", "in_ticks", "in_atr"),
    "history_metrics": lambda s, d: _rounded(dl.history_metrics(hourly(s, d)), "value"),
    "trade_summary": trade_summary,
    "factor_table": factor_table,
    "consistency": lambda s, d: _rounded(va.consistency(_trades(s, d), "strategy", ["ts", "k"]), "mean"),
    "walk_forward_report": walk_forward_report,
    "parameter_search": parameter_search,
    "condition_table": condition_table,
    "overlapping_doubles": overlapping_doubles,
    "not_judged": not_judged,
    "event_json": event_json,
    "null_line": lambda s, d: _rounded(me.null_line(hourly(s, d)), "expectancy"),
}
ORACLES = {
    "day_levels": DAY_LEVELS,
    "history_metrics": HISTORY,
    "trade_summary": SUMMARY,
    "factor_table": FACTORS,
    "consistency": f"WITH {TRADES}, x AS (SELECT *, ntile(4) OVER (PARTITION BY strategy ORDER BY ts, k) AS part FROM tr), m AS (SELECT strategy, part, avg(pnl) AS mean FROM x GROUP BY 1, 2) SELECT strategy, part, round(mean, 6) AS mean, count(*) FILTER (mean > 0) OVER (PARTITION BY strategy) AS positive_parts FROM m",
    "walk_forward_report": WALK,
    "parameter_search": SEARCH,
    "condition_table": CONDITIONS,
    "overlapping_doubles": OVERLAPS,
    "not_judged": "SELECT o_orderkey AS k, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "event_json": f"""WITH RECURSIVE {sql.BARS}, {EVENTS} SELECT instrument, i, '{{"direction":' || direction || ',"pattern":"' || pattern || '","variant":"' || variant || '"}}' AS features, pattern FROM evs""",
    "null_line": NULL_LINE,
}
