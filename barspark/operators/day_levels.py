"""The levels of the running session with their distances, and measures that need several sessions of history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.sessions import RTH, in_window, is_overnight, local, minute_of_day, session_date
from barspark.operators.indicators import atr

#: Levels of a day, in order, with why each may be missing; fixed.
NAMES = {
    "day_high": "no ticks of the session", "day_low": "no ticks of the session",
    "prev_day_high": "no session before", "prev_day_low": "no session before", "prev_day_close": "no session before",
    "asia_high": "no ticks in the window", "asia_low": "no ticks in the window", "london_high": "no ticks in the window", "london_low": "no ticks in the window",
    "overnight_high": "no ticks of the night", "overnight_low": "no ticks of the night",
    "ib_high": "regular hours have not begun", "ib_low": "regular hours have not begun",
    "or5_high": "regular hours have not begun", "or5_low": "regular hours have not begun", "or15_high": "regular hours have not begun", "or15_low": "regular hours have not begun", "or30_high": "regular hours have not begun", "or30_low": "regular hours have not begun",
    "cash_open": "regular hours have not begun",
}
#: Completed sessions that a measure needs; fixed.
REQUIRED = {"week_high": 5, "week_low": 5, "relative_volume": 10, "atr_percentile": 20}


def day_levels(ticks: DataFrame, bars: DataFrame, tick: float = 0.25) -> DataFrame:
    """(instrument, session, name, price, points, in_ticks, in_atr, missing): the last session's levels by name, as of its last tick, or why one is missing.

    One aggregation over sessions; only the last one of each instrument is unpivoted.
    """
    ts, p = F.col("ts"), F.col("price")
    m = minute_of_day(local(ts))
    rows = ticks.withColumn("session", session_date(ts))
    today = F.to_date(local(ts)) == F.col("session")
    spans = {"asia": in_window(ts, "asia"), "london": in_window(ts, "london"), "overnight": is_overnight(ts)}
    spans |= {n: today & m.between(RTH[0], RTH[0] + k - 1) for n, k in (("ib", 60), ("or5", 5), ("or15", 15), ("or30", 30))}
    order = F.struct("ts", "event_id")
    regular = today & m.between(RTH[0], RTH[1] - 1)
    days = rows.groupBy("instrument", "session").agg(
        F.max(p).alias("day_high"), F.min(p).alias("day_low"), F.max_by(p, order).alias("now"), *(f(F.when(inside, p)).alias(f"{n}_{s}") for n, inside in spans.items() for s, f in (("high", F.max), ("low", F.min))),
        F.min_by(F.when(regular, p), F.when(regular, order)).alias("cash_open"),
    )
    w = Window.partitionBy("instrument").orderBy("session")
    for name, c in (("high", "day_high"), ("low", "day_low"), ("close", "now")):
        days = days.withColumn(f"prev_day_{name}", F.lag(c).over(w))
    last = days.withColumn("_n", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("session")))).filter("_n = 1")
    unit = atr(bars).groupBy("instrument").agg(F.max_by("atr", "ts").alias("atr"))
    long = last.join(unit, "instrument").select("instrument", "session", "now", "atr", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("price"), F.lit(why).alias("why")) for n, why in NAMES.items()))).alias("l"))
    points = F.col("l.price") - F.col("now")
    return long.select("instrument", "session", "l.name", "l.price", points.alias("points"), (points / tick).alias("in_ticks"), (points / F.nullif("atr", F.lit(0.0))).alias("in_atr"), F.when(F.col("l.price").isNull(), F.col("l.why")).alias("missing"))


def history_metrics(bars: DataFrame, near_minutes: int = 15, least_sessions: int = 3) -> DataFrame:
    """(instrument, name, value, sessions_available, sessions_required): null where too few sessions are complete.

    week_high and week_low over the last five complete sessions and the running one; volume since the session
    began over its mean at the same elapsed time in the last ten; share of the last twenty sessions whose mean ATR
    within ``near_minutes`` of the clock was lower.
    """
    rows = atr(bars).withColumn("session", session_date(F.col("ts")))
    begun = F.min("ts").over(Window.partitionBy("instrument", "session"))
    rank = F.dense_rank().over(Window.partitionBy("instrument").orderBy(F.desc("session"))) - 1
    rows = rows.withColumn("age", rank).withColumn("elapsed", F.timestamp_diff("MINUTE", begun, F.col("ts"))).withColumn("clock", minute_of_day(F.col("ts")))
    last = rows.filter("age = 0").groupBy("instrument").agg(F.max("elapsed").alias("now_elapsed"), F.max_by("clock", "ts").alias("now_clock"), F.max_by("atr", "ts").alias("now_atr"))
    # one row an instrument
    rows = rows.filter(F.col("age") <= max(REQUIRED.values())).join(last, "instrument")
    apart = F.abs(F.col("clock") - F.col("now_clock"))
    near = F.least(apart, 1440 - apart) <= near_minutes
    sessions = rows.groupBy("instrument", "age", "now_atr").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum(F.when(F.col("elapsed") <= F.col("now_elapsed"), F.col("volume"))).alias("volume"), F.avg(F.when(near, F.col("atr"))).alias("atr"),
    )
    a = F.col("age")
    past = lambda k: a.between(1, k)
    known = past(20) & F.col("atr").isNotNull()
    out = sessions.groupBy("instrument").agg(
        F.max("age").cast("long").alias("complete"), F.max(F.when(a <= 5, F.col("high"))).alias("week_high"), F.min(F.when(a <= 5, F.col("low"))).alias("week_low"),
        (F.max(F.when(a == 0, F.col("volume"))) / F.nullif(F.avg(F.when(past(10), F.col("volume"))), F.lit(0.0))).alias("relative_volume"),
        F.when(F.count_if(known) >= least_sessions, F.count_if(known & (F.col("atr") < F.col("now_atr"))) / F.count_if(known)).alias("atr_percentile"),
    )
    complete = F.col("complete")
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.when(complete >= k, F.col(n)).alias("value"), F.lit(k).cast("long").alias("required")) for n, k in REQUIRED.items()))
    return out.select("instrument", complete, F.explode(named).alias("x")).select("instrument", "x.name", "x.value", F.col("complete").alias("sessions_available"), F.col("x.required").alias("sessions_required"))
