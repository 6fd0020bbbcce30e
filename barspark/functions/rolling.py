"""Window helpers: full frames, forward fills and exponential means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.sources.bars import series


def over_last(fn, column, n: int, keys=("instrument",)) -> Column:
    """fn over the last n rows; null until n values are there."""
    w = series(*keys).rowsBetween(-n + 1, 0)
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c).over(w) == n, fn(c).over(w))


def between(fn, column, first: int, last: int) -> Column:
    """fn over rows first..last relative to the current one; null unless all are there."""
    w = series().rowsBetween(first, last)
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c).over(w) == last - first + 1, fn(c).over(w))


def lagged(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(series())


def filled(column) -> Column:
    """The latest value so far."""
    return F.last(column, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))


def block_rows(q: float) -> int:
    """Rows after which a weight that falls by q a row is under 1e-140: still a double, and nothing beside the newest."""
    return max(1, int(322 / -math.log(q)))


def ewm(bars: DataFrame, column: str, alpha: float, out: str, min_periods: int = 1) -> DataFrame:
    """bars with the exponential mean y = (1 - alpha) * y + alpha * x of a column whose nulls, if any, all come first.

    The recursion is cut into blocks so long that of what lies before a block only the block before it counts.  In
    a block the mean is a running sum of values weighted by (1 - alpha) ** -row; what the block before hands on is
    its last sum.  Both are windows over the series as it is partitioned: no join, no further exchange.
    """
    q = 1 - alpha
    size, x, w = block_rows(q), F.col(column), series()
    r = F.col("i") % size
    seen = F.col("_ewm_n")
    part = F.when(x.isNull(), 0.0).when(seen == 1, x).otherwise(x * alpha)
    rows = bars.withColumn("_ewm_n", F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_ewm_block", F.floor(F.col("i") / size)).withColumn("_ewm_part", part * F.pow(F.lit(q), -r))
    inside = Window.partitionBy("instrument", "_ewm_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_ewm_sum", F.sum("_ewm_part").over(inside) * F.pow(F.lit(q), r))
    handed = F.last(F.when(r == size - 1, F.col("_ewm_sum")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    y = F.col("_ewm_sum") + F.coalesce(handed, F.lit(0.0)) * F.pow(F.lit(q), r + 1)
    return rows.withColumn(out, F.when(x.isNotNull() & (seen >= min_periods), y)).drop("_ewm_n", "_ewm_block", "_ewm_part", "_ewm_sum")


def with_ahead(events: DataFrame, bars: DataFrame, horizon: int, columns: tuple[str, ...]) -> DataFrame:
    """events with ``ahead_<column>``: arrays of the next ``horizon`` bars' values, shorter at the end of the series.

    Bars are put together in chunks of ``horizon``, so an event meets two chunks and not ``horizon`` rows; what is
    built for events only costs nothing at other bars.
    """
    chunk = F.floor(F.col("i") / horizon)
    chunks = bars.groupBy("instrument", chunk.alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("_bars"))
    first = F.floor((F.col("i") + 1) / horizon)
    rows = events.withColumn("_chunk", first).join(chunks.withColumnRenamed("_bars", "_near"), ["instrument", "_chunk"], "left")
    rows = rows.withColumn("_chunk", first + 1).join(chunks.withColumnRenamed("_bars", "_far"), ["instrument", "_chunk"], "left")
    none = F.array().cast(chunks.schema["_bars"].dataType)
    both = F.concat(F.coalesce("_near", none), F.coalesce("_far", none))
    rows = rows.withColumn("_ahead", F.slice(both, (F.col("i") + 2 - first * horizon).cast("int"), F.lit(horizon)))
    return rows.select(*events.columns, *(F.col("_ahead")[c].alias(f"ahead_{c}") for c in columns))
