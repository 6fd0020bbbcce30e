"""Resampling to sessions, session levels and data quality of bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.sessions import RTH, local, market_state, minute_of_day, session_date, to_utc
from barspark.operators.indicators import atr, previous_session
from barspark.operators.structure import with_last_swings
from barspark.sources.bars import series

#: Spans after 09:30 local by name, in minutes.
FIRST_MINUTES = {"or5": 5, "or15": 15, "or30": 30, "ib": 60}
#: The level sources, in order; fixed.
LEVEL_NAMES = ("pdh", "pdl", "pdc", "ib_high", "ib_low", "onh", "onl", "or5_high", "or5_low", "or15_high", "or15_low", "or30_high", "or30_low", "swing_high", "swing_low")


def _ohlcv() -> list:
    return [
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ]


def resample(bars: DataFrame, minutes: int, labels: str = "end") -> DataFrame:
    """Coarser bars labelled with the end of their bucket; a bar that is itself labelled with its end belongs to the bucket it ends in."""
    at = F.col("ts") - F.expr("interval 1 microsecond") if labels == "end" else F.col("ts")
    return bars.withColumn("bucket", F.window(at, f"{minutes} minutes")["end"]).groupBy("instrument", F.col("bucket")).agg(*_ohlcv()).withColumnRenamed("bucket", "ts")


def resample_4h(bars: DataFrame) -> DataFrame:
    """Four-hour bars of the local wall clock from 18:00, so a change of daylight saving shifts nothing; labelled with their end in UTC."""
    at = local(F.col("ts") - F.expr("interval 1 microsecond"))
    bucket = F.window(at, "4 hours", "4 hours", "2 hours")["end"]
    return bars.withColumn("bucket", bucket).groupBy("instrument", "bucket").agg(*_ohlcv()).withColumn("ts", to_utc(F.col("bucket"))).drop("bucket")


def resample_daily(bars: DataFrame) -> DataFrame:
    """One bar a session, labelled 17:00 local in UTC."""
    day = session_date(F.col("ts") - F.expr("interval 1 microsecond"))
    end = to_utc(F.col("session").cast("timestamp_ntz") + F.expr("interval 17 hours"))
    return bars.withColumn("session", day).groupBy("instrument", "session").agg(*_ohlcv()).withColumn("ts", end)


def opening_range(ticks: DataFrame, minutes: int) -> DataFrame:
    """High and low of the first minutes after 09:30 local, per session, and from when they are known."""
    rows = ticks.withColumn("session", session_date(F.col("ts"))).withColumn("m", minute_of_day(local(F.col("ts"))))
    inside = rows.filter((F.col("m") >= RTH[0]) & (F.col("m") < RTH[0] + minutes) & (F.to_date(local(F.col("ts"))) == F.col("session")))
    known = to_utc(F.col("session").cast("timestamp_ntz") + F.expr(f"interval {RTH[0] + minutes} minutes"))
    return inside.groupBy("instrument", "session").agg(F.max("price").alias("top"), F.min("price").alias("bottom")).withColumn("known_from", known)


def with_opening_range(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """The session's opening range at bars that end when it is known; null before, the evening before included."""
    rows = bars.withColumn("session", session_date(F.col("ts"))).join(ranges, ["instrument", "session"], "left")
    seen = F.col("ts") >= F.col("known_from")
    return rows.withColumn("or_high", F.when(seen, F.col("top"))).withColumn("or_low", F.when(seen, F.col("bottom"))).drop("top", "bottom", "known_from")


def session_levels(ticks: DataFrame) -> DataFrame:
    """Per session: open, high, low, close, overnight and regular-hours extremes, previous ones, the gap and whether it was filled."""
    rows = ticks.withColumn("session", session_date(F.col("ts"))).withColumn("m", minute_of_day(local(F.col("ts"))))
    day = F.col("m").between(RTH[0], RTH[1] - 1)
    night = (F.col("m") < RTH[0]) | (F.col("m") >= 1080)
    order = F.struct("ts", "event_id")
    out = rows.groupBy("instrument", "session").agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.max(F.when(night, F.col("price"))).alias("overnight_high"), F.min(F.when(night, F.col("price"))).alias("overnight_low"),
        F.max(F.when(day, F.col("price"))).alias("rth_high"), F.min(F.when(day, F.col("price"))).alias("rth_low"),
        F.min_by(F.when(day, F.col("price")), F.when(day, order)).alias("cash_open"), F.max_by(F.when(day, F.col("price")), F.when(day, order)).alias("cash_close"),
    )
    w = Window.partitionBy("instrument").orderBy("session")
    for c in ("high", "low", "close", "cash_close"):
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
    gap = F.col("cash_open") - F.col("prev_cash_close")
    filled = F.when(gap > 0, F.col("rth_low") <= F.col("prev_cash_close")).when(gap < 0, F.col("rth_high") >= F.col("prev_cash_close")).when(gap == 0, True)
    return out.withColumn("gap", gap).withColumn("gap_filled", filled)


def level_columns(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """bars with every level that may be known at them, null before it is.

    Previous session (pdh, pdl, pdc), overnight (onh, onl, from 09:30 local), the first 5, 15, 30 and 60 minutes after
    09:30 (or5_high ... ib_low, when they are over) and the last swings (swing_high, swing_low).
    """
    rows = ticks.withColumn("session", session_date(F.col("ts"))).withColumn("m", minute_of_day(local(F.col("ts")))).withColumn("today", F.to_date(local(F.col("ts"))) == F.col("session"))
    spans = {"on": (F.col("m") < RTH[0]) | (F.col("m") >= 1080)} | {name: F.col("today") & F.col("m").between(RTH[0], RTH[0] + n - 1) for name, n in FIRST_MINUTES.items()}
    extremes = [f(F.when(inside, F.col("price"))).alias(f"_{name}_{side}") for name, inside in spans.items() for side, f in (("high", F.max), ("low", F.min))]
    by_session = rows.groupBy("instrument", "session").agg(*extremes)
    out = previous_session(with_last_swings(atr(bars))).join(by_session, ["instrument", "session"], "left")
    for name in spans:
        known = to_utc(F.col("session").cast("timestamp_ntz") + F.expr(f"interval {RTH[0] + FIRST_MINUTES.get(name, 0)} minutes"))
        for side in ("high", "low"):
            out = out.withColumn("onh" if (name, side) == ("on", "high") else "onl" if name == "on" else f"{name}_{side}", F.when(F.col("ts") >= known, F.col(f"_{name}_{side}"))).drop(f"_{name}_{side}")
    return out.withColumnsRenamed({"prev_high": "pdh", "prev_low": "pdl", "prev_close": "pdc", "high_price": "swing_high", "low_price": "swing_low"})


def levels_long(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """A row for each bar and level known at it, with the bar before: instrument, i, high, low, close, prev_high, prev_low, prev_close, atr, name, level; bars without a positive ATR are left out."""
    rows = level_columns(bars, ticks)
    for c in ("high", "low", "close"):
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(series()))
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("level")) for n in LEVEL_NAMES))
    rows = rows.filter((F.col("atr") > 0) & (F.col("i") > 0)).withColumn("l", F.explode(named))
    return rows.select("instrument", "i", "high", "low", "close", "prev_high", "prev_low", "prev_close", "atr", "l.name", "l.level").filter("level is not null")


def volume_profile(bars: DataFrame, bin_size: float) -> DataFrame:
    """Volume by price bin and session: each bar's volume is spread evenly over the bins it touches."""
    first, last = F.floor(F.col("low") / bin_size), F.floor(F.col("high") / bin_size)
    rows = bars.withColumn("session", session_date(F.col("ts"))).withColumn("n", last - first + 1).withColumn("bin", F.explode(F.sequence(first, last)))
    return rows.groupBy("instrument", "session", "bin").agg(F.sum(F.col("volume") / F.col("n")).alias("volume"))


def value_area(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """Point of control and value area: grown from the fullest bin to the fuller neighbour, upwards on a tie, until ``share`` of the volume."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        volume = dict(zip(rows["bin"], rows["volume"].round(9), strict=True))  # sums in any order
        low, high = min(volume), max(volume)
        poc = min(volume, key=lambda b: (-volume[b], b))
        a = b = poc
        held, total = volume[poc], sum(volume.values())
        while held < share * total - 1e-9 and (a > low or b < high):
            up, down = volume.get(b + 1, 0.0) if b < high else -1.0, volume.get(a - 1, 0.0) if a > low else -1.0
            if up >= down:
                b += 1
                held += up
            else:
                a -= 1
                held += down
        return pd.DataFrame({"instrument": [rows["instrument"].iloc[0]], "session": [rows["session"].iloc[0]], "poc": [poc], "val": [a], "vah": [b]})

    return profile.groupBy("instrument", "session").applyInPandas(grow, "instrument string, session date, poc long, val long, vah long")


def _reasons() -> tuple:
    """Reasons to reject a bar, in the order in which they are tested."""
    return (
        ("instrument_missing", F.coalesce(F.trim("instrument"), F.lit("")) == ""),
        ("timeframe_unknown", ~F.coalesce(F.col("timeframe").isin("1m", "5m", "15m", "30m", "1h", "4h", "1d"), F.lit(False))),
        ("time_unreadable", F.col("ts").isNull()),
        ("time_in_future", F.col("ts") > F.col("now") + F.expr("interval 5 minutes")),
        ("price_not_finite", F.coalesce(F.isnan(F.col("open") + F.col("high") + F.col("low") + F.col("close")) | (F.abs(F.col("open") + F.col("high") + F.col("low") + F.col("close")) == float("inf")), F.lit(True))),
        ("volume_bad", F.coalesce((F.col("volume") < 0) | F.isnan("volume"), F.lit(True))),
        ("high_under_low", F.col("high") < F.col("low")),
        ("prices_inconsistent", (F.greatest("open", "close") > F.col("high")) | (F.least("open", "close") < F.col("low"))),
    )


def validated(bars: DataFrame, now) -> DataFrame:
    """bars with the first reason to reject each, or null."""
    rows, reason = bars.withColumn("now", now), F.lit(None).cast("string")
    for name, failed in reversed(_reasons()):
        reason = F.when(failed, name).otherwise(reason)
    return rows.withColumn("reject_reason", reason).drop("now")


def upserted(stored: DataFrame, arrived: DataFrame, keys: list[str], received: str) -> DataFrame:
    """The last row received of each key; of rows received at once the greatest by all of its columns, so every run keeps the same one."""
    rest = [F.desc(c) for c, t in stored.dtypes if not t.startswith(("map", "variant"))]
    w = Window.partitionBy(*keys).orderBy(F.desc(received), *rest)
    return stored.unionByName(arrived).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def gaps(bars: DataFrame, step: str = "1 hour", least: int = 1) -> DataFrame:
    """Holes between neighbouring bars: how many missing bars fall into market hours."""
    rows = bars.select("instrument", "ts", F.lead("ts").over(series()).alias("next_ts")).filter(F.col("next_ts") > F.col("ts") + F.expr(f"interval {step}"))
    missing = rows.withColumn("at", F.explode(F.sequence(F.col("ts") + F.expr(f"interval {step}"), F.col("next_ts") - F.expr(f"interval {step}"), F.expr(f"interval {step}"))))
    out = missing.groupBy("instrument", "ts", "next_ts").agg(F.count("*").alias("missing"), F.count_if(market_state(F.col("at")) == "open").alias("missing_open"))
    return out.filter(F.col("missing_open") >= least)


def roll_boundaries(bars: DataFrame, percent: float = 0.9) -> DataFrame:
    """Bars that open more than ``percent`` per cent from the close before."""
    pc = F.lag("close").over(series())
    jump = F.abs(F.col("open") - pc) / F.nullif(F.abs(pc), F.lit(0.0)) * 100
    return bars.withColumn("jump", jump).filter(F.col("jump") > percent).select("instrument", "i", "ts", "jump")


def coarse_to_fine(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Coarse bars with the number of the fine bar that ends when they do; null where none does."""
    return coarse.join(fine.select("instrument", "ts", F.col("i").alias("fine_i")), ["instrument", "ts"], "left")


def near_boundary(bars: DataFrame, boundaries: DataFrame, reach: int = 5) -> DataFrame:
    """bars with whether a boundary lies within ``reach`` bars; each boundary marks its own neighbours, so no ranges are joined."""
    marked = boundaries.select("instrument", F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach)).alias("i")).distinct().withColumn("near_roll", F.lit(True))
    return bars.join(marked, ["instrument", "i"], "left").withColumn("near_roll", F.coalesce("near_roll", F.lit(False)))


def compared(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Two sources bar by bar at the same time and one bar apart: how many meet, the largest difference, the share within tolerance."""
    shifts = [a.withColumn("shift", F.lit(k).cast("long")).withColumn("at", F.col("ts") + F.expr(f"interval {k} hours")) for k in (-1, 0, 1)]
    left = shifts[0].unionByName(shifts[1]).unionByName(shifts[2])
    other = b.select("instrument", F.col("ts").alias("at"), *(F.col(c).alias(f"b_{c}") for c in ("open", "high", "low", "close")))
    met = left.join(other, ["instrument", "at"])
    diff = F.greatest(*(F.abs(F.col(c) - F.col(f"b_{c}")) for c in ("open", "high", "low", "close")))
    return met.withColumn("d", diff).groupBy("instrument", "shift").agg(F.count("*").alias("n"), F.max("d").alias("largest"), F.avg((F.col("d") <= tolerance).cast("double")).alias("within"))


def as_of(left: DataFrame, right: DataFrame, columns: list[str], by: list[str], tie: str) -> DataFrame:
    """left with the latest row of right at or before its time.

    A union and a forward fill by day, so that one hot key is dealt over its days; a day's first rows take the last
    one of the days before, which come from one row a key and day.
    """
    held = [F.col(c).alias(c) for c in columns]
    a = left.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(right.select(F.struct(*held)).schema[0].dataType))
    b = right.select(*by, "ts", F.struct(*held).alias("_r"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"))
    both = a.withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType)).unionByName(b, allowMissingColumns=True)
    both = both.withColumn("_day", F.to_date("ts"))
    w = Window.partitionBy(*by, "_day").orderBy("ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    days = both.groupBy(*by, "_day").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("ts", "_tie"))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*by, "_day", F.last("_end", ignorenulls=True).over(earlier).alias("_earlier"))
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1").join(days, [*by, "_day"]).withColumn("_r", F.coalesce("_r", "_earlier"))
    return out.select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in columns))
