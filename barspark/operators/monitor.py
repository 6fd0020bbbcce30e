"""Coverage, seams, comparisons with the same time of other days, account risk and refresh of coarse bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.rolling import with_ahead
from barspark.functions.sessions import session_date
from barspark.operators.indicators import atr
from barspark.operators.levels import resample


def coverage(bars: DataFrame, now: Column, stale_after: float = 3.0) -> DataFrame:
    """Per instrument: bars, first, last, age in hours at a moment, and whether that is more than a few bars."""
    out = bars.groupBy("instrument").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    age = F.timestamp_diff("SECOND", F.col("last_ts"), now) / 3600
    return out.withColumn("age_hours", age).withColumn("stale", F.col("age_hours") > stale_after)


def seam(bars: DataFrame, at: Column, most_days: float = 4.0, most_percent: float = 3.0) -> DataFrame:
    """The last bar before a joint and the first one after it: their distance in days and in per cent, and whether both are small."""
    before, after = F.col("ts") < at, F.col("ts") >= at
    out = bars.groupBy("instrument").agg(
        F.max(F.when(before, F.col("ts"))).alias("left_ts"), F.max_by(F.when(before, F.col("close")), F.when(before, F.col("ts"))).alias("left_close"),
        F.min(F.when(after, F.col("ts"))).alias("right_ts"), F.min_by(F.when(after, F.col("open")), F.when(after, F.col("ts"))).alias("right_open"),
    )
    days = F.timestamp_diff("SECOND", F.col("left_ts"), F.col("right_ts")) / 86400
    jump = F.abs(F.col("right_open") - F.col("left_close")) / F.nullif(F.abs("left_close"), F.lit(0.0)) * 100
    out = out.withColumn("days", days).withColumn("jump", jump)
    return out.withColumn("fits", F.coalesce((F.col("days") <= most_days) & (F.col("jump") <= most_percent), F.lit(False)))


def volume_so_far(bars: DataFrame, sessions: int = 10) -> DataFrame:
    """Volume since the session began over its mean at the same elapsed time in the sessions before."""
    w = Window.partitionBy("instrument", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("session", session_date(F.col("ts"))).withColumn("clock", (F.hour("ts") * 60 + F.minute("ts")).cast("long")).withColumn("so_far", F.sum("volume").over(w))
    past = Window.partitionBy("instrument", "clock").orderBy("session").rowsBetween(-sessions, -1)
    return rows.withColumn("ratio", F.col("so_far") / F.nullif(F.avg("so_far").over(past), F.lit(0.0)))


def atr_percentile(bars: DataFrame, sessions: int = 20, least: int = 3) -> DataFrame:
    """Share of the sessions before whose ATR at the same clock was lower; null under a few of them."""
    rows = atr(bars).withColumn("clock", (F.hour("ts") * 60 + F.minute("ts")).cast("long"))
    past = Window.partitionBy("instrument", "clock").orderBy("ts").rowsBetween(-sessions, -1)
    rows = rows.withColumn("_p", F.collect_list("atr").over(past))
    lower = F.size(F.filter("_p", lambda x: x < F.col("atr")))
    return rows.withColumn("percentile", F.when(F.col("atr").isNotNull() & (F.size("_p") >= least), lower / F.size("_p"))).drop("_p", "clock")


def risk_figures(trades: DataFrame, by: str, day_limit: float) -> DataFrame:
    """Per group: result, worst day, days at the day limit, highest closing result and distance of the last from it."""
    days = trades.groupBy(by, F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("total", F.sum("pnl").over(w))
    out = days.groupBy(by).agg(F.sum("pnl").alias("net"), F.min("pnl").alias("worst_day"), F.count_if(F.col("pnl") <= -day_limit).alias("locked_days"), F.greatest(F.lit(0.0), F.max("total")).alias("highest"))
    return out.withColumn("below_highest", F.col("highest") - F.col("net"))


#: Account rules by profile: trading hours in local minutes, day loss, trailing drawdown, contracts; fixed assumptions.
ACCOUNT_RULES = {"small": (570, 960, 2_000.0, 20_000.0, 20), "large": (480, 1020, 20_000.0, 60_000.0, 60)}


def risk_checked(trades: DataFrame, by: str, order: list[str], minute: Column, contracts: Column) -> DataFrame:
    """Trades by account profile with every rule that they break: outside_hours, day_loss (already lost that day), drawdown (from the highest result so far), contracts."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy(by, F.to_date("ts")).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = trades.withColumn("_so_far", F.coalesce(F.sum("pnl").over(before), F.lit(0.0))).withColumn("_today", F.coalesce(F.sum("pnl").over(day), F.lit(0.0)))
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_below", F.greatest(F.lit(0.0), F.max("_so_far").over(upto)) - F.col("_so_far"))
    rules = F.array(*(F.struct(F.lit(n).alias("profile"), *(F.lit(x).alias(c) for c, x in zip(("first", "end", "loss", "drawdown", "most"), r, strict=True))) for n, r in ACCOUNT_RULES.items()))
    rows = rows.withColumn("r", F.explode(rules))
    broken = F.array_compact(F.array(
        F.when((minute < F.col("r.first")) | (minute >= F.col("r.end")), "outside_hours"), F.when(F.col("_today") <= -F.col("r.loss"), "day_loss"),
        F.when(F.col("_below") >= F.col("r.drawdown"), "drawdown"), F.when(contracts > F.col("r.most"), "contracts"),
    ))
    return rows.select(by, *order, F.col("r.profile").alias("profile"), broken.alias("broken"))


def refreshed(coarse: DataFrame, fine: DataFrame, minutes: int, since: Column) -> DataFrame:
    """Coarse bars with all buckets from a moment on built anew from fine bars."""
    fresh = resample(fine.filter(F.col("ts") > since), minutes)
    return coarse.filter(F.col("ts") <= since).select(*fresh.columns).unionByName(fresh)


def look_ahead(events: DataFrame) -> DataFrame:
    """Events that claim to be known before they begin or are confirmed; there must be none."""
    return events.filter((F.col("origin") > F.col("available")) | (F.col("origin") < 0))


def equity_curve(trades: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Running result, its peak and the fall from it after every trade."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("equity", F.sum("pnl").over(w))
    return rows.withColumn("fall", F.greatest(F.lit(0.0), F.max("equity").over(w)) - F.col("equity"))


def paths(bars: DataFrame, horizon: int) -> DataFrame:
    """Closes of the next bars relative to the next open, as an array; shorter at the end of the series."""
    rows = with_ahead(bars.select("instrument", "i"), bars, horizon, ("open", "close")).withColumn("entry", F.get("ahead_open", 0))
    return rows.filter("entry is not null").select("instrument", "i", "entry", F.transform("ahead_close", lambda x: x - F.col("entry")).alias("path"))
