"""Trading days and early closes of a futures exchange, from rules.

Closed: weekends, New Year's Day, Good Friday and Christmas Day, the fixed ones on the next Monday if they fall on a
Sunday.  Early: the other United States holidays, the day after Thanksgiving and 24 December, where they are trading days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (Butcher's rule)."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + k - 7 * div(a + 11 * h + 22 * k, 451) + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def _nth(day: Column, month: int, weekday: int, n: int) -> Column:
    """Whether a date is the n-th weekday (0 is Monday) of a month; n = -1 is the last one."""
    last = F.dayofmonth(F.last_day(day))
    right = F.dayofmonth(day) > last - 7 if n < 0 else F.ceil(F.dayofmonth(day) / 7) == n
    return (F.month(day) == month) & (F.weekday(day) == weekday) & right


def _fixed(day: Column, month: int, of_month: int) -> Column:
    """Whether a date is a fixed holiday, or the Monday after one on a Sunday."""
    at = F.make_date(F.year(day), F.lit(month), F.lit(of_month))
    return (day == at) | ((F.weekday(at) == 6) & (day == F.date_add(at, 1)))


def is_trading_day(day: Column) -> Column:
    closed = (F.weekday(day) >= 5) | _fixed(day, 1, 1) | _fixed(day, 12, 25) | (day == F.date_sub(easter(F.year(day)), 2))
    return ~closed


def is_early_close(day: Column) -> Column:
    holidays = _nth(day, 1, 0, 3) | _nth(day, 2, 0, 3) | _nth(day, 5, 0, -1) | ((F.year(day) >= 2022) & _fixed(day, 6, 19)) | _fixed(day, 7, 4) | _nth(day, 9, 0, 1) | _nth(day, 11, 3, 4)
    after_thanksgiving = _nth(F.date_sub(day, 1), 11, 3, 4)
    eve = (F.month(day) == 12) & (F.dayofmonth(day) == 24)
    return is_trading_day(day) & (holidays | after_thanksgiving | eve)


def next_trading_day(day: Column) -> Column:
    """The first trading day from a date on; within a week there always is one."""
    return F.element_at(F.filter(F.sequence(day, F.date_add(day, 7)), is_trading_day), 1)


def trading_days(spark, first: str, last: str) -> DataFrame:
    """day, early and number of the trading days between two dates, both included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).filter(is_trading_day(F.col("day")))
    return days.select("day", is_early_close(F.col("day")).alias("early"), F.row_number().over(Window.orderBy("day")).cast("long").alias("number"))  # a few thousand days
