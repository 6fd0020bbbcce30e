"""How far double patterns are from an ideal W or M, what follows in steps, and the state of several timeframes at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.rolling import with_ahead
from barspark.operators.indicators import atr, rsi
from barspark.operators.levels import resample
from barspark.operators.structure import double_patterns, with_last_swings
from barspark.sources.bars import numbered

#: Points of the template, the places of its peak that are tried, and the share of the line that is averaged; fixed.
POINTS = 101
PEAKS = [k / 100 for k in range(10, 91, 2)]
SMOOTH = 0.12
#: Fractions of the height from the neck that are looked for; fixed.
STEPS = (0.25, 0.5, 0.75, 1.0)


def form_error(line: Column, rising: Column) -> Column:
    """(error, peak) of a line against the nearest tent between its ends: root mean square at 101 points of the line scaled to [0, 1]; upside down where not rising.

    The line is a running mean over a share of its length first; null under five points or without any height.
    """
    width = F.greatest(F.lit(3), F.floor(F.size(line) * SMOOTH)).cast("int")
    count = F.size(line) - width + 1
    means = F.when(count >= 5, F.transform(F.sequence(F.lit(1), count), lambda k: F.aggregate(F.slice(line, k, width), F.lit(0.0), lambda s, x: s + x) / width))

    def against(s: Column) -> Column:
        low, high = F.array_min(s), F.array_max(s)

        def scaled(j: Column) -> Column:
            at = j * (F.size(s) - 1) / (POINTS - 1)
            first = F.floor(at).cast("int")
            a, b = F.get(s, first), F.get(s, F.least(first + 1, F.size(s) - 1))
            y = (a + (at - first) * (b - a) - low) / (high - low)
            return F.when(rising, y).otherwise(1 - y)

        ys = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), scaled)

        def error(y: Column, p: Column) -> Column:
            x = lambda k: (k - 1) / (POINTS - 1)
            tent = lambda k: F.when(x(k) <= p, x(k) / p).otherwise((1 - x(k)) / (1 - p))
            total = F.aggregate(F.sequence(F.lit(1), F.lit(POINTS)), F.lit(0.0), lambda t, k: t + F.pow(F.get(y, k - 1) - tent(k), 2.0))
            return F.struct(F.round(F.sqrt(total / POINTS), 9).alias("error"), p.alias("peak"))

        # the points are worked out once, then compared with every tent
        best = F.transform(F.array(ys), lambda y: F.array_min(F.transform(F.array(*map(F.lit, PEAKS)), lambda p: error(y, p))))
        return F.when(high > low, F.get(best, 0))

    return F.get(F.transform(F.array(means), against), 0)


def with_form(bars: DataFrame, most_bars: int = 120) -> DataFrame:
    """Double patterns with how far the line between their two swings is from the ideal, and where its peak lies."""
    found = double_patterns(bars, most_bars=most_bars).withColumn("second_i", F.col("i"))
    rows = with_ahead(found.withColumn("i", F.col("first_i") - 1), bars, most_bars + 1, ("close",))
    line = F.slice("ahead_close", F.lit(1), (F.col("second_i") - F.col("first_i") + 1).cast("int"))
    rows = rows.withColumn("f", form_error(line, F.col("pattern") == "double_bottom"))
    return rows.select("instrument", "pattern", "first_i", F.col("second_i").alias("i"), "available", "price", "neck", "break_i", F.col("f.error").alias("form_error"), F.col("f.peak").alias("peak"))


def confirmation_steps(bars: DataFrame, horizon: int = 120) -> DataFrame:
    """Per double pattern and step: after how many bars from the next open on the price first covers a fraction of the way from the second swing to the neck, before it trades beyond that swing; null if never.

    A bar that does both counts as beyond.
    """
    found = double_patterns(bars).select("instrument", "pattern", F.col("i").alias("swing_i"), F.col("available").alias("i"), "price", "neck")
    rows = with_ahead(found, bars, horizon, ("high", "low"))
    up = F.col("pattern") == "double_bottom"
    first = lambda values, test: F.nullif(F.array_position(F.transform(values, test), True), F.lit(0).cast("long"))
    gone = F.when(up, first("ahead_low", lambda x: x < F.col("price"))).otherwise(first("ahead_high", lambda x: x > F.col("price")))
    rows = rows.withColumn("invalid_at", gone).withColumn("step", F.explode(F.array(*map(F.lit, STEPS))))
    aim = F.col("price") + F.col("step") * (F.col("neck") - F.col("price"))
    rows = rows.withColumn("_aim", aim)
    hit = F.when(up, first("ahead_high", lambda x: x >= F.col("_aim"))).otherwise(first("ahead_low", lambda x: x <= F.col("_aim")))
    rows = rows.withColumn("_hit", hit)
    reached = F.when(F.col("invalid_at").isNull() | (F.col("_hit") < F.col("invalid_at")), F.col("_hit"))
    return rows.select("instrument", "pattern", "swing_i", "step", reached.alias("reached_at"), "invalid_at")


def best_of_first(found: DataFrame) -> DataFrame:
    """Of the patterns that begin at one swing the one with the least form error."""
    best = F.min_by(F.struct("i", "form_error"), F.struct("form_error", "i"))
    return found.filter("form_error is not null").groupBy("instrument", "pattern", "first_i").agg(best.alias("b")).select("instrument", "pattern", "first_i", "b.*")


def market_state(bars: DataFrame, at: Column, minutes: tuple[int, ...] = (60, 120, 240)) -> DataFrame:
    """(instrument, minutes, ts, bars, close, atr, rsi, trend, swing_high, swing_low) of each timeframe as it stood at a moment: later bars aren't seen."""
    seen = bars.filter(F.col("ts") <= at)
    out = None
    for m in minutes:
        rows = with_last_swings(rsi(atr(numbered(resample(seen, m)))))
        row = F.struct("ts", (F.col("i") + 1).alias("bars"), "close", "atr", "rsi", "trend", F.col("high_price").alias("swing_high"), F.col("low_price").alias("swing_low"))
        last = rows.groupBy("instrument").agg(F.max_by(row, "ts").alias("s")).select("instrument", F.lit(m).cast("long").alias("minutes"), "s.*")
        out = last if out is None else out.unionByName(last)
    return out
