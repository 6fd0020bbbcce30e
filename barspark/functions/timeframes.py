"""Timeframe labels, and prices in points, ticks and money."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of the stored timeframes, a day being 23 hours; fixed.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1380}
DAILY = ("1d", "d", "day", "daily")


def normalized(label: str) -> str:
    """One spelling of a timeframe: 60m is 1h, 240m is 4h, day is 1d; anything unreadable is an error."""
    text = label.strip().lower()
    if text in DAILY:
        return "1d"
    found = re.fullmatch(r"([0-9]+)([mh])", text)
    if not found:
        raise ValueError(f"unknown timeframe {label!r}; known: {', '.join(MINUTES)}")
    n, unit = int(found[1]), found[2]
    return f"{n // 60}h" if unit == "m" and n in (60, 240) else f"{n}{unit}"


def minutes_of(label: str) -> int:
    text = normalized(label)
    return MINUTES["1d"] if text == "1d" else int(text[:-1]) * (60 if text[-1] == "h" else 1)


def timeframe_of(minutes: int) -> str:
    """The timeframe of so many minutes; never the nearest one."""
    names = {m: t for t, m in MINUTES.items()}
    if minutes not in names:
        raise ValueError(f"no timeframe has {minutes} minutes; known: {', '.join(f'{m} ({t})' for m, t in sorted(names.items()))}")
    return names[minutes]


def points_to_ticks(points: Column, tick: float) -> Column:
    return points / tick


def points_to_money(points: Column, point_value: float) -> Column:
    return points * point_value


def round_to_tick(price: Column, tick: float) -> Column:
    """The nearest tick; halves go to the even one."""
    return F.bround(price / tick) * tick
