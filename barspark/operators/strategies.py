"""The strategy library: parameterised entry and exit rules, stops and targets; ideas and their filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.rolling import over_last
from barspark.functions.sessions import is_liquid, is_thin
from barspark.operators.indicators import adx, flag_signals, rsi, session_vwap
from barspark.operators.levels import level_columns
from barspark.operators.research import upcoming
from barspark.operators.rules import Above, Below, CrossesAbove, CrossesBelow, InTime, IsSet, Reentry, Rule
from barspark.operators.structure import double_patterns

#: Stop columns by variant, for long and short; None is a distance in ATR.  Fixed.
STOPS = {
    "atr": (None, None),
    "last_swing": ("swing_low", "swing_high"),
    "second_last_swing": ("low_before", "high_before"),
    "previous_day": ("pdl", "pdh"),
    "pattern": ("w_second", "m_second"),
}


@dataclass(frozen=True)
class Strategy:
    """Rules for either side; a side without an entry rule isn't traded."""

    name: str
    long: Rule | None
    short: Rule | None
    long_exit: Rule | None = None
    short_exit: Rule | None = None
    stop_atr: float | None = 1.5
    target_atr: float | None = 3.0
    most_bars: int | None = 120
    stop_columns: tuple[str | None, str | None] = (None, None)

    def names(self) -> set[str]:
        """The columns that its rules and stops read."""
        out = {c for c in self.stop_columns if c}
        for rule in (self.long, self.short, self.long_exit, self.short_exit):
            out |= rule.names() if rule else set()
        return out


def _day(start: time = time(9, 30), end: time = time(15, 45)) -> Rule:
    return InTime(start, end)


def prev_day_breakout(buffer: float = 1.0, rsi_max: float = 70.0, rsi_min: float = 30.0, hours: Rule | None = None, **kwargs) -> Strategy:
    hours = hours or _day()
    return Strategy("prev_day_breakout", CrossesAbove("close", "pdh", buffer) & Below("rsi", rsi_max) & hours, CrossesBelow("close", "pdl", buffer) & Above("rsi", rsi_min) & hours, CrossesBelow("close", "vwap"), CrossesAbove("close", "vwap"), **kwargs)


def rsi_mean_reversion(oversold: float = 30.0, overbought: float = 70.0, middle: float = 50.0, hours: Rule | None = None, **kwargs) -> Strategy:
    hours = hours or _day()
    given = {"stop_atr": 2.0, "target_atr": None, "most_bars": 60} | kwargs
    return Strategy("rsi_mean_reversion", CrossesAbove("rsi", oversold) & hours, CrossesBelow("rsi", overbought) & hours, CrossesAbove("rsi", middle), CrossesBelow("rsi", middle), **given)


def flag_breakout(with_trend: bool = True, hours: Rule | None = None, **kwargs) -> Strategy:
    hours = hours or _day()
    up, down = IsSet("flag_up") & hours, IsSet("flag_down") & hours
    if with_trend:
        up, down = up & Above("sma20", "sma50"), down & Below("sma20", "sma50")
    return Strategy("flag_breakout", up, down, CrossesBelow("close", "sma20"), CrossesAbove("close", "sma20"), **({"stop_atr": 1.2, "target_atr": 2.5, "most_bars": 90} | kwargs))


def vwap_trend(hours: Rule | None = None, **kwargs) -> Strategy:
    hours = hours or _day()
    return Strategy("vwap_trend", CrossesAbove("close", "vwap") & Above("sma20", "sma50") & hours, CrossesBelow("close", "vwap") & Below("sma20", "sma50") & hours, CrossesBelow("close", "vwap"), CrossesAbove("close", "vwap"), **kwargs)


def ib_breakout(buffer: float = 1.0, hours: Rule | None = None, **kwargs) -> Strategy:
    hours = hours or _day()
    return Strategy("ib_breakout", CrossesAbove("close", "ib_high", buffer) & hours, CrossesBelow("close", "ib_low", buffer) & hours, CrossesBelow("close", "vwap"), CrossesAbove("close", "vwap"), **kwargs)


def vwap_reversion(deviation: float = 1.5, hours: Rule | None = None, name: str = "vwap_reversion", **kwargs) -> Strategy:
    hours = hours or _day()
    given = {"target_atr": 2.0, "most_bars": 60} | kwargs
    return Strategy(name, Reentry("close", "vwap", "atr", deviation, -1) & hours, Reentry("close", "vwap", "atr", deviation, 1) & hours, Above("close", "vwap"), Below("close", "vwap"), **given)


def power_hour_vwap(deviation: float = 2.0, hours: Rule | None = None, **kwargs) -> Strategy:
    return vwap_reversion(deviation, hours or _day(time(15), time(15, 55)), "power_hour_vwap", **({"target_atr": 3.0} | kwargs))


def _double(name: str, suffix: str, least: float, hours: Rule | None, **kwargs) -> Strategy:
    hours = hours or _day()
    long, short = IsSet(f"w_{suffix}") & hours, IsSet(f"m_{suffix}") & hours
    if least > 0:
        long, short = long & Above("w_confidence", least), short & Above("m_confidence", least)
    return Strategy(name, long, short, **({"most_bars": 60} | kwargs))


def double_confirmed(least: float = 0.0, hours: Rule | None = None, **kwargs) -> Strategy:
    return _double("double_confirmed", "found", least, hours, **kwargs)


def double_neck_break(least: float = 0.0, hours: Rule | None = None, **kwargs) -> Strategy:
    return _double("double_neck_break", "break", least, hours, **kwargs)


LIBRARY: dict[str, Callable[..., Strategy]] = {f.__name__: f for f in (prev_day_breakout, rsi_mean_reversion, flag_breakout, vwap_trend, ib_breakout, vwap_reversion, power_hour_vwap, double_confirmed, double_neck_break)}


def build(name: str, **parameters) -> Strategy:
    if name not in LIBRARY:
        raise KeyError(f"unknown strategy {name!r}; known: {', '.join(sorted(LIBRARY))}")
    return LIBRARY[name](**parameters)


def with_stop(strategy: Strategy, variant: str) -> Strategy:
    """The same strategy with the stop at a structure instead of a distance in ATR, which stays the fallback."""
    if variant not in STOPS:
        raise KeyError(f"unknown stop {variant!r}; known: {', '.join(sorted(STOPS))}")
    return replace(strategy, name=f"{strategy.name}@{variant}", stop_columns=STOPS[variant])


def prepared(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """bars with every column that the library's rules and stops read."""
    rows = adx(rsi(session_vwap(flag_signals(level_columns(bars, ticks)))))
    rows = rows.withColumn("sma20", over_last(F.avg, "close", 20)).withColumn("sma50", over_last(F.avg, "close", 50))
    doubles = double_patterns(bars)
    for letter, pattern in (("w", "double_bottom"), ("m", "double_top")):
        own = doubles.filter(F.col("pattern") == pattern)
        known = own.groupBy("instrument", F.col("available").alias("i")).agg(F.max("confidence").alias(f"{letter}_confidence"), F.max_by("price", "confidence").alias(f"{letter}_second"), F.lit(True).alias(f"{letter}_found"))
        broken = own.filter("break_i is not null").groupBy("instrument", F.col("break_i").alias("i")).agg(F.lit(True).alias(f"{letter}_break"))
        rows = rows.join(known, ["instrument", "i"], "left").join(broken, ["instrument", "i"], "left")
    return rows


def entries(rows: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Every bar at which an entry rule holds: strategy, direction, entry at the close, stop and target; bars without a positive ATR are left out.

    A structural stop on the wrong side of the entry is replaced by the distance in ATR.
    """
    missing = {c for s in strategies for c in s.names()} - set(rows.columns)
    if missing:
        raise ValueError(f"strategies read columns that the bars lack: {sorted(missing)}")
    fired = []
    for s in strategies:
        for d, rule, stop in ((1, s.long, s.stop_columns[0]), (-1, s.short, s.stop_columns[1])):
            if rule is None:
                continue
            null = F.lit(None).cast("double")
            by_atr = null if s.stop_atr is None else F.col("close") - d * s.stop_atr * F.col("atr")
            at = F.coalesce(F.when((F.col("close") - F.col(stop)) * d > 0, F.col(stop)), by_atr) if stop else by_atr
            target = null if s.target_atr is None else F.col("close") + d * s.target_atr * F.col("atr")
            fired.append(F.when(rule.column(), F.struct(F.lit(s.name).alias("strategy"), F.lit(d).cast("long").alias("direction"), at.alias("stop"), target.alias("target"))))
    kept = ("instrument", "i", "ts", "close", "atr", "adx")
    # rules look at the bar before, so they are worked out before any bar is left out
    out = rows.withColumn("_f", F.array_compact(F.array(*fired))).filter(F.col("atr") > 0).select(*kept, F.explode("_f").alias("f"))
    return out.select("instrument", "i", "ts", "f.strategy", "f.direction", F.col("close").alias("entry"), "f.stop", "f.target", "atr", "adx")


#: Idea setups: the strategy of each and whether it goes on with a move or turns it; fixed.
SETUPS = {
    "prev_day_break": ("prev_day_breakout", "continuation"),
    "ib_break": ("ib_breakout", "continuation"),
    "vwap_reversion": ("vwap_reversion", "reversion"),
    "flag_break": ("flag_breakout", "continuation"),
}


def ideas(rows: DataFrame, setups: tuple[str, ...] = tuple(SETUPS)) -> DataFrame:
    """Entries of the idea setups, with setup, kind and the ratio of target to stop."""
    unknown = set(setups) - set(SETUPS)
    if unknown:
        raise KeyError(f"unknown setups: {sorted(unknown)}")
    found = entries(rows, [build(SETUPS[s][0]) for s in setups])
    of = lambda k: F.create_map(*(F.lit(x) for s in setups for x in (SETUPS[s][0], (s, SETUPS[s][1])[k])))[F.col("strategy")]
    ratio = F.abs(F.col("target") - F.col("entry")) / F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))
    return found.select(of(0).alias("setup"), of(1).alias("kind"), "*", ratio.alias("reward_risk")).drop("strategy")


def covered_blackout(rows: DataFrame, releases: DataFrame, before: int, after: int, since: Column, until: Column) -> DataFrame:
    """rows with ``blackout``: whether a release is near, or null outside the time that the calendar covers."""
    out = upcoming(rows, F.col("ts") - F.make_interval(mins=F.lit(after)), releases, "_near")
    inside = F.coalesce(F.col("_near") <= F.col("ts") + F.make_interval(mins=F.lit(before)), F.lit(False))
    return out.withColumn("blackout", F.when(F.col("ts").between(since, until), inside)).drop("_near")


def judged(found: DataFrame, adx_trend: float = 20.0, adx_range: float = 25.0) -> DataFrame:
    """Ideas (with adx and blackout) with all reasons to reject them, all filters that could not be checked, and whether they are rejected.

    A filter passes, rejects or can't be checked; none stops the others.
    """
    reasons = (
        F.when((F.col("kind") == "continuation") & (F.col("adx") < adx_trend), "adx_too_low"),
        F.when((F.col("kind") == "reversion") & (F.col("adx") > adx_range), "adx_too_high"),
        F.when(~is_liquid(F.col("ts")), "outside_liquid_hours"),
        F.when(is_thin(F.col("ts")), "thin_hours"),
        F.when(F.col("blackout"), "blackout"),
    )
    unchecked = (F.when(F.col("adx").isNull(), "adx"), F.when(F.col("blackout").isNull(), "blackout"))
    out = found.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("unchecked", F.array_compact(F.array(*unchecked)))
    return out.withColumn("rejected", F.size("reasons") > 0)


def audited(written: DataFrame, rows: DataFrame, tick: float = 0.25, within_ticks: float = 0.5) -> DataFrame:
    """Ideas as they were written against what the bars give now: confirmed, bar_missing, not_found or the first value that differs."""
    now = ideas(rows).select("instrument", "ts", "setup", "direction", *(F.col(c).alias(f"now_{c}") for c in ("entry", "stop", "target")))
    there = rows.select("instrument", "ts").distinct().withColumn("there", F.lit(True))
    both = written.join(there, ["instrument", "ts"], "left").join(now, ["instrument", "ts", "setup", "direction"], "left")
    differs = lambda c: ~(F.col(c).eqNullSafe(F.col(f"now_{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"now_{c}")) <= within_ticks * tick, F.lit(False)))
    state = F.when(F.col("there").isNull(), "bar_missing").when(F.col("now_entry").isNull(), "not_found").when(differs("entry"), "entry_differs").when(differs("stop"), "stop_differs").when(differs("target"), "target_differs").otherwise("confirmed")
    return both.select(*written.columns, state.alias("audit"))
