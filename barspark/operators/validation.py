"""Whole trade summaries, factors, guards against leaks, parameter grids and walk-forward reports."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.sessions import local


def trade_summary(trades: DataFrame, by: str, order: list[str], bars: float, capital: float) -> DataFrame:
    """The twenty figures of a run: trades (ts, pnl, bars_held) by a column; a trade of zero counts as lost.

    Drawdown is against the running peak of the equity itself, in per cent of a positive peak only; Sharpe ratios
    are of the daily changes of closing equity, the first day having none.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    won = F.col("pnl") > 0
    rows = trades.withColumn("_equity", F.sum("pnl").over(w)).withColumn("_island", F.count_if(won).over(w)).withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    rows = rows.withColumn("_peak", F.max("_equity").over(w)).withColumn("_down", F.col("_peak") - F.col("_equity"))
    streaks = rows.filter(~won).groupBy(by, "_island").agg(F.count("*").alias("k")).groupBy(by).agg(F.max("k").alias("max_consecutive_losses"))
    pnl, gain, loss = F.col("pnl"), F.when(won, F.col("pnl")), F.when(~won, F.col("pnl"))
    worst = F.max(F.struct("_down", (-F.col("_k")).alias("k"), "_peak"))
    out = rows.groupBy(by).agg(
        F.count("*").alias("trades"), F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.sum(pnl).alias("total_pnl"), F.sum(gain).alias("_g"), F.sum(loss).alias("_l"),
        F.coalesce(F.avg(gain), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.avg(pnl).alias("avg_trade"), F.coalesce(F.max(gain), F.lit(0.0)).alias("largest_win"), F.coalesce(F.min(loss), F.lit(0.0)).alias("largest_loss"),
        worst.alias("_w"), F.avg("bars_held").alias("avg_bars_held"), (F.sum("bars_held") / bars * 100).alias("exposure_pct"),
    )
    out = out.withColumn("win_rate", F.col("wins") / F.col("trades"))
    g, lost = F.coalesce("_g", F.lit(0.0)), F.abs(F.coalesce("_l", F.lit(0.0)))
    out = out.withColumn("profit_factor", F.when(lost > 0, g / lost).when(g > 0, float("inf")).otherwise(0.0)).withColumn("expectancy", F.col("win_rate") * F.col("avg_win") + (1 - F.col("win_rate")) * F.col("avg_loss"))
    out = out.withColumn("max_drawdown", F.col("_w._down")).withColumn("max_drawdown_pct", F.when(F.col("_w._peak") > 0, F.col("_w._down") / F.col("_w._peak")))
    days = trades.groupBy(by, F.to_date("ts").alias("_day")).agg(F.sum("pnl").alias("change")).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_day"))).filter("_n > 1")
    ratio = lambda c: F.when((F.count(c) >= 2) & (F.stddev_samp(c) > 0), F.sqrt(F.lit(252.0)) * F.avg(c) / F.stddev_samp(c))
    days = days.groupBy(by).agg(ratio(F.col("change")).alias("sharpe_pnl"), ratio(F.col("change") / capital).alias("sharpe_on_capital"), F.count("*").alias("trading_days"))
    out = out.join(streaks, by, "left").join(days, by, "left")
    return out.select(
        by, "trades", "wins", "losses", "win_rate", "total_pnl", "profit_factor", "expectancy", "avg_win", "avg_loss", "avg_trade", "largest_win", "largest_loss", "max_drawdown", "max_drawdown_pct",
        F.coalesce("max_consecutive_losses", F.lit(0).cast("long")).alias("max_consecutive_losses"), "avg_bars_held", "exposure_pct", "sharpe_pnl", "sharpe_on_capital", F.coalesce("trading_days", F.lit(0).cast("long")).alias("trading_days"),
    )


# -- factors: columns that put a trade into a named bucket, null where it can't be told ------------


def hour_bucket(ts: Column) -> Column:
    h = F.hour(local(ts))
    return F.when(h.between(9, 10), "open").when(h.between(11, 13), "midday").when(h.between(14, 15), "close").otherwise("outside")


def weekday(ts: Column) -> Column:
    return F.date_format(local(ts), "E")


def bounded(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the first bound that a value doesn't exceed."""
    if len(names) != len(bounds) + 1:
        raise ValueError("one name more than bounds")
    out = F.when(value.isNotNull(), names[-1])
    for b, n in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(value <= b, n).otherwise(out)
    return out


def yes_no(value: Column) -> Column:
    return F.when(value, "yes").when(~value, "no")


def sign(value: Column) -> Column:
    return F.when(value > 0, "positive").when(value < 0, "negative").when(value == 0, "zero")


def relation(price: Column, level: Column) -> Column:
    return F.when(price > level, "above").when(price < level, "below").when(price == level, "at")


def location(price: Column, low: Column, high: Column) -> Column:
    return F.when(price > high, "above").when(price < low, "below").when(low.isNotNull() & high.isNotNull(), "inside")


def category(value: Column, names: dict[int, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.bround(value).cast("int")]


def factor_table(trades: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """Per factor and bucket: count, share won, mean, deviation and t of the mean; the factors are unpivoted, so the trades are read once."""
    named = F.array(*(F.struct(F.lit(n).alias("factor"), c.alias("bucket")) for n, c in factors.items()))
    rows = trades.select("pnl", F.explode(named).alias("f")).select("pnl", "f.*").filter("bucket is not null")
    out = rows.groupBy("factor", "bucket").agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("won"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("sd"))
    return out.withColumn("t", F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)))


def consistency(trades: DataFrame, by: str, order: list[str], parts: int = 4) -> DataFrame:
    """Mean trade in equal parts of the run, and in how many of them it is positive."""
    rows = trades.withColumn("part", F.ntile(parts).over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    means = rows.groupBy(by, "part").agg(F.avg("pnl").alias("mean"))
    return means.withColumn("positive_parts", F.count_if(F.col("mean") > 0).over(Window.partitionBy(by)))


# -- leaks, grids, walk forward ---------------------------------------------------------------------


def only_before(rows: DataFrame, cut, ts: str = "ts") -> DataFrame:
    """rows, or an error if any lies at or after a moment that a search must not see."""
    last = rows.agg(F.max(ts)).first()[0]
    if last is not None and last >= cut:
        raise ValueError(f"rows up to {last} reach beyond {cut}")
    return rows


def only_within(rows: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """rows, or an error if any lies outside [start, end)."""
    first, last = rows.agg(F.min(ts), F.max(ts)).first()
    if first is not None and (first < start or last >= end):
        raise ValueError(f"rows from {first} to {last} lie outside [{start}, {end})")
    return rows


def prepared_then_cut(bars: DataFrame, prepare: Callable[[DataFrame], DataFrame], cut, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Both sides of a cut of bars whose columns were worked out over the whole series first, so that the second side begins with full windows."""
    rows = prepare(bars)
    return rows.filter(F.col(ts) < cut), rows.filter(F.col(ts) >= cut)


def grid(**values: list) -> list[dict]:
    """Every combination of parameters."""
    return [dict(zip(values, x, strict=True)) for x in itertools.product(*values.values())]


def searched(runs: DataFrame, by: list[str], objective: Column, least_trades: int) -> DataFrame:
    """Parameter sets by an objective over their trades: those with enough trades first, then the best; rank 1 is the choice."""
    out = runs.groupBy(*by).agg(F.count("*").alias("trades"), objective.alias("objective")).withColumn("enough", F.col("trades") >= least_trades)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("enough"), F.desc("objective"), *by)).cast("long"))  # a row a parameter set


def walk_forward_report(windows: DataFrame, by: str) -> DataFrame:
    """windows (by, start, part, n, net) of train and test parts: tests, share of positive ones, sum of their results, and the mean of test over train."""
    wide = windows.groupBy(by, "start").pivot("part", ["train", "test"]).agg(F.first("net").alias("net"))
    return wide.groupBy(by).agg(F.count("test").alias("tests"), F.avg((F.col("test") > 0).cast("double")).alias("positive_share"), F.sum("test").alias("net"), (F.avg("test") / F.when(F.avg("train") > 0, F.avg("train"))).alias("test_over_train"))


def in_order(windows: DataFrame) -> DataFrame:
    """Windows whose test part does not come after their train part; there must be none."""
    ends = windows.groupBy("instrument", "start").agg(F.max(F.when(F.col("part") == "train", F.col("ts"))).alias("train_end"), F.min(F.when(F.col("part") == "test", F.col("ts"))).alias("test_start"))
    return ends.filter(F.col("test_start") <= F.col("train_end"))
