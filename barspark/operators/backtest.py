"""Position machine, trade metrics, splits, factor tests and account replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRADES = "instrument string, direction long, entry_i long, exit_i long, entry double, exit double, bars long, reason string, pnl double"


def positions(rows: DataFrame, stop_atr: float, target_atr: float, most_bars: int, slippage: float = 0.0, commission: float = 0.0) -> DataFrame:
    """Trades of one position at a time, by instrument.

    rows has i, session, open, high, low, close, atr, go_long, go_short.  Orders of one bar are filled at the next
    bar's open; within a bar the stop comes before the target, on the entry bar too; then the time limit and the
    session's end, both at the close.  No position outlives a session, so sessions are worked off independently.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        out, held, order = [], None, None
        last = part["i"].iloc[-1]
        for i, o, h, lo, c, a, long, short in part[["i", "open", "high", "low", "close", "atr", "go_long", "go_short"]].itertuples(index=False):
            if order and not held:
                d, unit = order
                price = o + d * slippage
                held = (d, i, price, price - d * stop_atr * unit, price + d * target_atr * unit)
            order = None
            if held:
                d, at, price, stop, target = held
                exit_price, reason = None, ""
                if (lo <= stop) if d > 0 else (h >= stop):
                    exit_price, reason = (min(stop, o) if d > 0 else max(stop, o)) - d * slippage, "stop"
                elif (h >= target) if d > 0 else (lo <= target):
                    exit_price, reason = target, "target"
                elif i - at + 1 >= most_bars:
                    exit_price, reason = c - d * slippage, "time"
                elif i == last:
                    exit_price, reason = c - d * slippage, "session"
                if reason:
                    out.append((part["instrument"].iloc[0], d, at, i, price, exit_price, i - at + 1, reason, d * (exit_price - price) - commission))
                    held = None
            if not held and i != last and a == a and a > 0:
                order = (1, a) if long else (-1, a) if short else None
        return pd.DataFrame(out, columns=[x.split()[0] for x in TRADES.split(", ")])

    return rows.groupBy("instrument", "session").applyInPandas(run, TRADES)


def trade_metrics(trades: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Counts, sums, profit factor, drawdown and longest losing streak; a trade of zero counts as lost."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("equity", F.sum("pnl").over(w)).withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(w)))
    won = F.col("pnl") > 0
    rows = rows.withColumn("island", F.count_if(won).over(w))
    streaks = rows.filter(~won).groupBy(by, "island").agg(F.count("*").alias("k")).groupBy(by).agg(F.max("k").alias("losing_streak"))
    out = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(won).alias("wins"), F.sum(F.when(won, F.col("pnl")).otherwise(0.0)).alias("gross_profit"), F.sum(F.when(won, 0.0).otherwise(-F.col("pnl"))).alias("gross_loss"),
        F.avg("pnl").alias("mean"), F.max(F.col("peak") - F.col("equity")).alias("drawdown"),
    )
    out = out.join(streaks, by, "left").withColumn("losing_streak", F.coalesce("losing_streak", F.lit(0).cast("long")))
    return out.withColumn("profit_factor", F.col("gross_profit") / F.nullif("gross_loss", F.lit(0.0)))


def daily_sharpe(trades: DataFrame, by: str) -> DataFrame:
    """Annualised ratio of the daily changes of closing equity; the first day has no change."""
    days = trades.groupBy(by, F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy(by).orderBy("day")
    change = days.withColumn("_n", F.row_number().over(w)).filter("_n > 1")
    return change.groupBy(by).agg(F.count("*").alias("days"), (F.sqrt(F.lit(252.0)) * F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0))).alias("sharpe"))


def factor_test(trades: DataFrame, factor: str) -> DataFrame:
    """Per value of a factor: count, share won, mean, deviation and t of the mean."""
    out = trades.groupBy(factor).agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("won"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("sd"))
    return out.withColumn("t", F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)))


def split(rows: DataFrame, fractions: tuple[float, float] = (0.6, 0.8), by: str = "instrument") -> DataFrame:
    """train, validation or oos by row number within the series; a boundary row belongs to the later part."""
    n = F.count("*").over(Window.partitionBy(by))
    a, b = (F.floor(n * f) for f in fractions)
    return rows.withColumn("split", F.when(F.col("i") < a, "train").when(F.col("i") < b, "validation").otherwise("oos"))


def walk_forward(rows: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Each bar with every window that holds it, as train or test part; windows start every ``step`` bars and are complete."""
    sizes = rows.groupBy("instrument").agg(F.count("*").alias("n")).filter(F.col("n") >= train + test)
    starts = sizes.select("instrument", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - train - test, F.lit(step).cast("long"))).alias("start"))
    bars = starts.withColumn("i", F.explode(F.sequence(F.col("start"), F.col("start") + train + test - 1)))
    return bars.join(rows, ["instrument", "i"]).withColumn("part", F.when(F.col("i") < F.col("start") + train, "train").otherwise("test"))


def account_replay(trades: DataFrame, by: str, start: float, risk_budget: float, day_limit: float, trailing: float) -> DataFrame:
    """Trades in order under account rules: size by risk, a lock for the day after ``day_limit`` lost, an end-of-day trailing floor that stops at the start, and an end on a breach."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "k"])
        balance, floor, alive, day, day_pnl, taken, skipped = start, start - trailing, True, None, 0.0, 0, 0
        for ts, risk, points in part[["ts", "risk", "pnl"]].itertuples(index=False):
            if not alive:
                skipped += 1
                continue
            if ts.date() != day:
                floor = max(floor, min(start, balance - trailing))
                day, day_pnl = ts.date(), 0.0
            size = int(risk_budget // risk) if risk > 0 else 0
            if size < 1 or day_pnl <= -day_limit:
                skipped += 1
                continue
            balance += size * points
            day_pnl += size * points
            taken += 1
            alive = balance > floor
        return pd.DataFrame({by: [part[by].iloc[0]], "taken": [taken], "skipped": [skipped], "balance": [round(balance, 6)], "alive": [alive]})

    return trades.groupBy(by).applyInPandas(run, f"{by} string, taken long, skipped long, balance double, alive boolean")
