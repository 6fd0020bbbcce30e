"""Trading sessions in local time.

A session's day is the local date, one day on from 18:00.  Times are TIMESTAMP_NTZ in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
SESSION_START_HOUR = 18
#: Local trading windows by name: zone, first minute, end minute (exclusive).
WINDOWS = {"asia": ("Asia/Tokyo", 540, 1080), "london": ("Europe/London", 480, 990), "new_york": ("America/New_York", 570, 1020)}
RTH = (570, 960)


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def to_utc(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def minute_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).cast("long")


def session_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone) + F.expr(f"interval {24 - SESSION_START_HOUR} hours"))


def market_state(ts: Column) -> Column:
    """open, maintenance (16:00-17:00 Chicago) or weekend (Friday 16:00 to Sunday 17:00)."""
    at = local(ts, "America/Chicago")
    day, minute = F.dayofweek(at), minute_of_day(at)  # 1 is Sunday
    weekend = (day == 7) | ((day == 6) & (minute >= 960)) | ((day == 1) & (minute < 1020))
    return F.when(weekend, "weekend").when((minute >= 960) & (minute < 1020), "maintenance").otherwise("open")


def in_window(ts: Column, name: str) -> Column:
    zone, first, end = WINDOWS[name]
    minute = minute_of_day(local(ts, zone))
    return (minute >= first) & (minute < end)


def primary_session(ts: Column) -> Column:
    """The active window that starts last; null where none is active."""
    return F.when(in_window(ts, "new_york"), "new_york").when(in_window(ts, "london"), "london").when(in_window(ts, "asia"), "asia")


def is_rth(ts: Column) -> Column:
    at = local(ts)
    return F.weekday(at).between(0, 4) & (minute_of_day(at) >= RTH[0]) & (minute_of_day(at) < RTH[1])


def minutes_to_rth_open(ts: Column) -> Column:
    """Minutes to the next weekday 09:30 local, at or after ts."""
    at = local(ts)
    day = F.to_date(at)
    passed = minute_of_day(at) > RTH[0]
    first = F.when(passed, F.date_add(day, 1)).otherwise(day)
    shift = F.when(F.weekday(first) == 5, 2).when(F.weekday(first) == 6, 1).otherwise(0)
    open_local = F.date_add(first, shift).cast("timestamp_ntz") + F.expr("interval 570 minutes")
    return F.timestamp_diff("MINUTE", ts, to_utc(open_local))


def session_bounds(day: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """First and end moment (exclusive) of a session's day, in UTC."""
    at = lambda d: to_utc(d.cast("timestamp_ntz") + F.expr(f"interval {SESSION_START_HOUR} hours"), zone)
    return at(F.date_sub(day, 1)), at(day)


def floor_to(ts: Column, minutes: int) -> Column:
    """The beginning of the bucket of so many minutes."""
    return F.window(ts, f"{minutes} minutes")["start"]


def _next(ts: Column, zone: str, minute: int, weekdays: bool) -> Column:
    """The next moment after ts at which it is a minute of the day somewhere."""
    at = local(ts, zone)
    day = F.to_date(at)
    reached = at >= day.cast("timestamp_ntz") + F.make_interval(mins=F.lit(minute))
    first = F.when(reached, F.date_add(day, 1)).otherwise(day)
    if weekdays:
        first = F.date_add(first, F.when(F.weekday(first) == 5, 2).when(F.weekday(first) == 6, 1).otherwise(0))
    return to_utc(first.cast("timestamp_ntz") + F.make_interval(mins=F.lit(minute)), zone)


def minutes_until(ts: Column, zone: str, minute: int, weekdays: bool = False) -> Column:
    return F.timestamp_diff("SECOND", ts, _next(ts, zone, minute, weekdays)) / 60


def minutes_until_rth_open(ts: Column) -> Column:
    """0 while regular hours run."""
    return F.when(is_rth(ts) & (market_state(ts) == "open"), 0.0).otherwise(minutes_until(ts, ZONE, RTH[0], True))


def minutes_until_rth_close(ts: Column) -> Column:
    """Null outside regular hours."""
    return F.when(is_rth(ts) & (market_state(ts) == "open"), minutes_until(ts, ZONE, RTH[1]))


def minutes_until_maintenance(ts: Column) -> Column:
    return minutes_until(ts, "America/Chicago", 960)


def is_liquid(ts: Column, span: tuple[int, int] = RTH) -> Column:
    at = local(ts)
    return (market_state(ts) == "open") & F.weekday(at).between(0, 4) & minute_of_day(at).between(span[0], span[1] - 1)


def is_first_hour(ts: Column) -> Column:
    """The hour after the daily break, 17:00 to 18:00 Chicago."""
    return (market_state(ts) == "open") & minute_of_day(local(ts, "America/Chicago")).between(1020, 1079)


def is_thin(ts: Column, span: tuple[int, int] = (720, 840)) -> Column:
    return minute_of_day(local(ts)).between(span[0], span[1] - 1)


def is_overnight(ts: Column) -> Column:
    """From the session's begin to 09:30 local, whatever the weekday."""
    m = minute_of_day(local(ts))
    return (m < RTH[0]) | (m >= SESSION_START_HOUR * 60)


def minutes_from_rth_open(ts: Column) -> Column:
    return minute_of_day(local(ts)) - RTH[0]
