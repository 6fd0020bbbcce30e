"""Rules over the current and the previous bar, compiled to columns.

A rule on a missing value never fires; so ``Not`` of it does.  A reference is a column name or a number.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.sessions import ZONE, local, minute_of_day
from barspark.sources.bars import series


def _now(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def _before(x) -> Column:
    return F.lag(x).over(series()) if isinstance(x, str) else F.lit(float(x))


class Rule:
    def column(self) -> Column:
        raise NotImplementedError

    def names(self) -> set[str]:
        """The columns that the rule reads."""
        out: set[str] = set()
        for value in vars(self).values():
            for x in value if isinstance(value, tuple) else (value,):
                if isinstance(x, Rule):
                    out |= x.names()
                elif isinstance(x, str):
                    out.add(x)
        return out

    def __and__(self, other: "Rule") -> "Rule":
        return AllOf((self, other))

    def __or__(self, other: "Rule") -> "Rule":
        return AnyOf((self, other))

    def __invert__(self) -> "Rule":
        return Not(self)


@dataclass(frozen=True)
class AllOf(Rule):
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for r in self.rules:
            out = out & r.column()
        return out


@dataclass(frozen=True)
class AnyOf(Rule):
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        out = F.lit(False)
        for r in self.rules:
            out = out | r.column()
        return out


@dataclass(frozen=True)
class Not(Rule):
    rule: Rule

    def column(self) -> Column:
        return ~self.rule.column()


@dataclass(frozen=True)
class Above(Rule):
    left: str
    right: str | float
    offset: float = 0.0

    def column(self) -> Column:
        return F.coalesce(_now(self.left) > _now(self.right) + self.offset, F.lit(False))


@dataclass(frozen=True)
class Below(Rule):
    left: str
    right: str | float
    offset: float = 0.0

    def column(self) -> Column:
        return F.coalesce(_now(self.left) < _now(self.right) - self.offset, F.lit(False))


@dataclass(frozen=True)
class CrossesAbove(Rule):
    left: str
    right: str | float
    buffer: float = 0.0

    def column(self) -> Column:
        return F.coalesce((_before(self.left) <= _before(self.right)) & (_now(self.left) > _now(self.right) + self.buffer), F.lit(False))


@dataclass(frozen=True)
class CrossesBelow(Rule):
    left: str
    right: str | float
    buffer: float = 0.0

    def column(self) -> Column:
        return F.coalesce((_before(self.left) >= _before(self.right)) & (_now(self.left) < _now(self.right) - self.buffer), F.lit(False))


@dataclass(frozen=True)
class Rising(Rule):
    left: str

    def column(self) -> Column:
        return F.coalesce(_now(self.left) > _before(self.left), F.lit(False))


@dataclass(frozen=True)
class Falling(Rule):
    left: str

    def column(self) -> Column:
        return F.coalesce(_now(self.left) < _before(self.left), F.lit(False))


@dataclass(frozen=True)
class WasFarFrom(Rule):
    """The previous bar lay more than ``multiple`` of a unit from a reference."""

    left: str
    right: str
    unit: str
    multiple: float

    def column(self) -> Column:
        return F.coalesce((_before(self.unit) > 0) & (F.abs(_before(self.left) - _before(self.right)) > self.multiple * _before(self.unit)), F.lit(False))


@dataclass(frozen=True)
class Always(Rule):
    def column(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Reentry(Rule):
    """The previous bar lay ``multiple`` of a unit or more from a reference, on one side (1 above, -1 below); the current one lies nearer and not yet through it."""

    left: str
    right: str
    unit: str
    multiple: float
    side: int

    def names(self) -> set[str]:
        return {self.left, self.right, self.unit}

    def column(self) -> Column:
        was, now = (self.side * (f(self.left) - f(self.right)) for f in (_before, _now))
        known = (_before(self.unit) > 0) & (_now(self.unit) > 0)
        return F.coalesce(known & (was >= self.multiple * _before(self.unit)) & (now < self.multiple * _now(self.unit)) & (now > 0), F.lit(False))


@dataclass(frozen=True)
class HeldFor(Rule):
    """The position, whose age in bars is a column, is ``bars`` old at least."""

    bars: int
    left: str = "bars_in_trade"

    def column(self) -> Column:
        return F.coalesce(F.col(self.left) >= self.bars, F.lit(False))


@dataclass(frozen=True)
class IsSet(Rule):
    left: str

    def column(self) -> Column:
        return F.coalesce(F.col(self.left).cast("boolean"), F.lit(False))


@dataclass(frozen=True)
class InTime(Rule):
    """Local time from start to end, both included; over midnight if start is later."""

    start: time
    end: time

    def names(self) -> set[str]:
        return {"ts"}

    def column(self) -> Column:
        m = minute_of_day(local(F.col("ts"), ZONE))
        a, b = (t.hour * 60 + t.minute for t in (self.start, self.end))
        return (m >= a) & (m <= b) if a <= b else (m >= a) | (m <= b)


def signals(bars: DataFrame, entries: dict[str, tuple[Rule, int]], stop_atr: float = 1.5, target_atr: float = 3.0) -> DataFrame:
    """Every bar at which an entry rule holds: name, direction, entry at the close, stop and target; bars without a positive ATR are left out."""
    missing = {c for rule, _ in entries.values() for c in rule.names()} - set(bars.columns)
    if missing:
        raise ValueError(f"rules read columns that the bars lack: {sorted(missing)}")
    fired = F.array_compact(F.array(*(F.when(rule.column(), F.struct(F.lit(name).alias("name"), F.lit(d).cast("long").alias("direction"))) for name, (rule, d) in entries.items())))
    rows = bars.withColumn("_f", fired).filter(F.col("atr") > 0).select("instrument", "i", "close", "atr", F.explode("_f").alias("f"))
    d = F.col("f.direction")
    return rows.select("instrument", "i", "f.name", d.alias("direction"), F.col("close").alias("entry"), (F.col("close") - d * stop_atr * F.col("atr")).alias("stop"), (F.col("close") + d * target_atr * F.col("atr")).alias("target"))
