"""Levels by distance, candles, divergences, vintages, blackouts, fills, factors and tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.folds import folded
from barspark.functions.sessions import session_date
from barspark.operators.indicators import atr, previous_session, rsi
from barspark.operators.structure import swings
from barspark.sources.bars import series

#: Costs by profile: commission a side and slippage in ticks a side; fixed assumptions, not measurements.
COST_PROFILES = (("none", 0.0, 0.0), ("retail", 1.25, 1.0), ("stressed", 1.25, 3.0))


def third_friday(month: Column) -> Column:
    """Of the month in which a date lies."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(month, "month"), 1), "FRI"), 14)


def third_last_business_day(month: Column) -> Column:
    last = F.last_day(month)
    days = F.filter(F.sequence(F.date_sub(last, 9), last), lambda d: F.weekday(d) < 5)
    return F.element_at(days, -3)


def session_delta(ticks: DataFrame, buys: Column) -> DataFrame:
    """Signed flow by hour and its sum since the session began; null while the session has no flow."""
    rows = ticks.withColumn("session", session_date(F.col("ts"))).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    rows = rows.groupBy("instrument", "session", "hour").agg(F.sum(F.when(buys, 1).otherwise(-1)).alias("delta"), F.count("*").alias("flow"))
    w = Window.partitionBy("instrument", "session").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum_delta", F.when(F.sum("flow").over(w) > 0, F.sum("delta").over(w)))


def rsi_divergence(bars: DataFrame, k: int = 3, least: float = 2.0) -> DataFrame:
    """Neighbouring swings of one kind where price and RSI part: higher high with lower RSI, lower low with higher RSI."""
    known = rsi(bars).select("instrument", "i", "rsi")
    w = Window.partitionBy("instrument", "kind").orderBy("i")
    rows = swings(bars, k).join(known, ["instrument", "i"]).withColumn("p0", F.lag("price").over(w)).withColumn("r0", F.lag("rsi").over(w))
    bear = (F.col("kind") == "high") & (F.col("price") > F.col("p0")) & (F.col("rsi") < F.col("r0") - least)
    bull = (F.col("kind") == "low") & (F.col("price") < F.col("p0")) & (F.col("rsi") > F.col("r0") + least)
    return rows.filter(bear | bull).select("instrument", "i", "available", F.when(F.col("kind") == "low", 1).otherwise(-1).cast("long").alias("direction"), (F.col("rsi") - F.col("r0")).alias("gap"))


def candles(bars: DataFrame) -> DataFrame:
    """Engulfing bars and pin bars, the latter with a wick of twice the body and half the span at least; the lower wick is looked at first."""
    w = series()
    po, pc = F.lag("open").over(w), F.lag("close").over(w)
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    bull = (pc < po) & (F.col("close") > F.col("open")) & (F.col("open") <= pc) & (F.col("close") >= po)
    bear = (pc > po) & (F.col("close") < F.col("open")) & (F.col("open") >= pc) & (F.col("close") <= po)
    kind = F.when(bull, "bullish_engulfing").when(bear, "bearish_engulfing").when((span > 0) & (lower >= 2 * body) & (lower >= 0.5 * span), "bullish_pin").when((span > 0) & (upper >= 2 * body) & (upper >= 0.5 * span), "bearish_pin")
    return bars.withColumn("candle", kind).filter("candle is not null").select("instrument", "i", "candle")


def equal_extremes(bars: DataFrame, k: int = 3, near_atr: float = 0.2, tick: float = 0.25, near_ticks: float = 4.0, back: int = 120, most: int = 8) -> DataFrame:
    """Swings of one kind at about one price: a running cluster whose members all lie within tolerance, none older than ``back`` bars; a swing without a known ATR begins a new one."""
    known = atr(bars).select("instrument", F.col("i").alias("available"), "atr")
    rows = swings(bars, k).join(known, ["instrument", "available"]).select("instrument", "kind", "i", "available", "price", "atr")

    def step(state, row):
        instrument, kind, i, available, price, unit = row
        members = [(j, p) for j, p in state["members"] if i - j <= back]
        if unit and unit > 0 and members and all(abs(p - price) <= max(near_ticks * tick, near_atr * unit) for _, p in members):
            members = [*members, (i, price)][-most:]
            yield instrument, kind, members[0][0], i, available, len(members), sum(p for _, p in members) / len(members)
        else:
            members = [(i, price)]
        state["members"] = members

    return folded(rows, ("instrument", "kind"), ("i",), lambda: {"members": []}, step, "instrument string, kind string, first long, i long, available long, members long, level double")


def nearest_levels(bars: DataFrame, most: int = 3) -> DataFrame:
    """The last bar of each instrument with its nearest levels, in points and in ATR."""
    rows = previous_session(atr(bars))
    w = Window.partitionBy("instrument", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("day_high", F.max("high").over(w)).withColumn("day_low", F.min("low").over(w))
    names = ("prev_high", "prev_low", "prev_close", "day_high", "day_low")
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("ts")))).filter("_n = 1")
    long = last.unpivot(["instrument", "close", "atr"], list(names), "name", "level").filter("level is not null")
    long = long.withColumn("points", F.col("level") - F.col("close")).withColumn("in_atr", F.col("points") / F.nullif("atr", F.lit(0.0)))
    near = Window.partitionBy("instrument").orderBy(F.abs("points"), "name")
    return long.withColumn("rank", F.row_number().over(near).cast("long")).filter(F.col("rank") <= most).select("instrument", "rank", "name", "level", "points", "in_atr")


def vintages(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Revisions of each series, numbered in the order in which they became available."""
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy(*keys).orderBy(at, "id")).cast("long"))


def appended_vintages(stored: DataFrame, arrived: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The rows of ``arrived`` that are new: a value of a series that became available at a moment is stored once and never changed; of several that arrive at once the one with the least id stays."""
    first = Window.partitionBy(*keys, at).orderBy("id")
    fresh = arrived.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return fresh.join(stored.select(*keys, at), [*keys, at], "left_anti").select(*arrived.columns)


def decoded_vintages(raw: DataFrame, keys: list[str], at: str, value: str = "value") -> DataFrame:
    """Raw observations without those that are only a dot, as numbers, with their revision: how many of the series' values were there by then."""
    rows = raw.filter(F.trim(value) != ".").withColumn(value, F.expr(f"try_cast({value} as double)"))
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy(*keys).orderBy(at, value)).cast("long"))


def known_at(rows: DataFrame, keys: list[str], at: str, moment: Column) -> DataFrame:
    """The newest revision of each series at a moment; later ones are not seen."""
    seen = rows.filter(F.col(at) <= moment)
    return seen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("id")))).filter("_n = 1").drop("_n")


def upcoming(rows: DataFrame, at: Column, releases: DataFrame, out: str) -> DataFrame:
    """rows with the first release (column ``at``) at or after a time of theirs.

    By day: within a day by one window over both, and from the first releases of later days where the day has none
    left; the window over days holds a row a day.
    """
    own = rows.withColumn("_at", at).withColumn("_row", F.struct(*rows.columns)).select("_at", "_row", F.lit(None).cast("timestamp_ntz").alias("_rel"))
    both = own.unionByName(releases.select(F.col("at").alias("_at"), F.col("at").alias("_rel")), allowMissingColumns=True).withColumn("_day", F.to_date("_at"))
    w = Window.partitionBy("_day").orderBy(F.desc("_at"), F.col("_rel").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_same", F.last("_rel", ignorenulls=True).over(w))
    days = both.groupBy("_day").agg(F.min("_rel").alias("_first"))
    later = days.select("_day", F.first("_first", ignorenulls=True).over(Window.orderBy("_day").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    return both.filter("_row is not null").join(later, "_day").select("_row.*", F.coalesce("_same", "_later").alias(out))


def blackouts(bars: DataFrame, releases: DataFrame, before: int, after: int) -> DataFrame:
    """bars with whether a release lies within ``before`` minutes ahead or ``after`` minutes back, and the next release.

    One lies in that span if the first one from its beginning on does; so both are lookups, and no pairs are made.
    """
    rows = upcoming(bars.select("instrument", "i", "ts"), F.col("ts"), releases, "next_release")
    rows = upcoming(rows, F.col("ts") - F.make_interval(mins=F.lit(after)), releases, "_from")
    inside = F.coalesce(F.col("_from") <= F.col("ts") + F.make_interval(mins=F.lit(before)), F.lit(False))
    return rows.select("instrument", "i", inside.alias("blackout"), "next_release")


def paired_fills(fills: DataFrame, order: str = "order_id") -> DataFrame:
    """First and last fill of each order as a trade; orders with one fill are open and left out."""
    return fills.groupBy(order).agg(F.count("*").alias("fills"), F.min_by("price", "k").alias("entry"), F.max_by("price", "k").alias("exit"), F.min_by("qty", "k").alias("qty"), F.min_by("side", "k").alias("side")).filter("fills > 1").withColumn("points", F.when(F.col("side") == "A", -1).otherwise(1) * (F.col("exit") - F.col("entry")))


def under_costs(trades: DataFrame, by: str, tick: float = 0.25) -> DataFrame:
    """Net result by cost profile."""
    profiles = F.array(*(F.struct(F.lit(n).alias("profile"), F.lit(c).alias("commission"), F.lit(s).alias("slippage")) for n, c, s in COST_PROFILES))
    rows = trades.withColumn("p", F.explode(profiles))
    net = F.col("pnl") - 2 * F.col("p.commission") - 2 * F.col("p.slippage") * tick
    return rows.groupBy(by, F.col("p.profile").alias("profile")).agg(F.count("*").alias("n"), F.sum(net).alias("net"), F.avg((net > 0).cast("double")).alias("won"))


def in_sample_ratio(trades: DataFrame, by: str, cut: Column) -> DataFrame:
    """Mean trade in and out of sample and their ratio; null where the first is not positive."""
    out = trades.groupBy(by).agg(F.avg(F.when(F.col("ts") < cut, F.col("pnl"))).alias("inside"), F.avg(F.when(F.col("ts") >= cut, F.col("pnl"))).alias("outside"))
    return out.withColumn("robustness", F.when(F.col("inside") > 0, F.col("outside") / F.col("inside")))


def best_day_share(trades: DataFrame, by: str) -> DataFrame:
    """The best day's part of all winning days."""
    days = trades.groupBy(by, F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl"))
    out = days.groupBy(by).agg(F.count("*").alias("days"), F.max("pnl").alias("best"), F.sum(F.greatest(F.lit(0.0), "pnl")).alias("gained"))
    return out.withColumn("share", F.when(F.col("best") > 0, F.col("best") / F.col("gained")))


def quantile_factor(trades: DataFrame, column: str, cuts=(0.25, 0.5, 0.75)) -> DataFrame:
    """trades with the bucket of a column, bounds being its percentiles over all trades."""
    bounds = trades.agg(F.percentile(column, F.array(*map(F.lit, cuts))).alias("b"))
    rows = trades.crossJoin(F.broadcast(bounds))  # one row of bounds
    return rows.withColumn("bucket", F.size(F.filter("b", lambda x: x <= F.col(column))).cast("long")).drop("b")


def conditional(bars: DataFrame, condition: Column, horizon: int) -> DataFrame:
    """Ends after ``horizon`` bars from the next open where a condition holds, against all bars."""
    w = series()
    rows = bars.withColumn("hit", F.coalesce(condition, F.lit(False))).withColumn("end", F.lead("close", horizon).over(w) - F.lead("open").over(w)).filter("end is not null")
    out = rows.groupBy("instrument").agg(
        F.count_if("hit").alias("n"), F.avg(F.when(F.col("hit"), F.col("end"))).alias("mean"), F.stddev_pop(F.when(F.col("hit"), F.col("end"))).alias("sd"),
        F.avg((F.when(F.col("hit"), F.col("end")) > 0).cast("double")).alias("won"), F.avg("end").alias("all_mean"), F.avg((F.col("end") > 0).cast("double")).alias("all_won"),
    )
    return out.withColumn("edge", F.col("mean") - F.col("all_mean"))


def ladder(rows: DataFrame) -> DataFrame:
    """Shares won over all, by quartile and by year, as grouping sets."""
    rows.createOrReplaceTempView("ladder_rows")
    return rows.sparkSession.sql("SELECT quartile, year, count(*) AS n, avg(CAST(won AS DOUBLE)) AS won FROM ladder_rows GROUP BY GROUPING SETS ((), (quartile), (year))")


def sampled_by_month(rows: DataFrame, at: str, n: int, order: Column) -> DataFrame:
    """n rows of every month in a fixed random order."""
    month = F.date_trunc("month", at).cast("timestamp_ntz")
    return rows.withColumn("month", month).withColumn("_n", F.row_number().over(Window.partitionBy("month").orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def data_hash(rows: DataFrame, day: Column, line: Column) -> DataFrame:
    """SHA-256 of a table: of the days' hashes in order, each of its parts' in order, a part being the lines whose own hash begins alike, in order; so a day with very many lines goes in 256 parts."""
    lines = rows.select(day.alias("day"), F.sha2(line, 256).alias("l")).withColumn("part", F.left("l", F.lit(2)))
    parts = lines.groupBy("day", "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("h"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n"), 256)
    days = parts.groupBy("day").agg(joined("part").alias("h"))
    return days.agg(F.count("*").alias("days"), joined("day").alias("hash"))


def _beta_part(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 301):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def t_p_value(t: float, freedom: float) -> float:
    """Two-sided p of Student's t."""
    if t != t or freedom <= 0:
        return float("nan")
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + (b * math.log1p(-x) if x < 1 else 0.0)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_part(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_part(b, a, 1 - x) / b


def with_p_values(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A table of tests (n, t) with p values and whether each holds after Bonferroni's correction; the tables are small."""
    p = F.pandas_udf(lambda t, n: pd.Series([t_p_value(a, b - 1) for a, b in zip(t, n, strict=True)]), "double")
    tests = F.count("*").over(Window.partitionBy())
    return tested.withColumn("p", p(F.col("t").cast("double"), F.col("n").cast("double"))).withColumn("significant", F.col("p") < alpha / tests)
