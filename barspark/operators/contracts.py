"""One continuous series from the overlapping files of several contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTRACT = ("root", "year", "month")


def front_spans(days: DataFrame, least_bytes: int = 40) -> DataFrame:
    """From when until when each contract is the front one, by the days that its files hold: (root, year, month, start, end).

    days has root, year, month, day and n_bytes.  A contract takes over on its first day (files of ``least_bytes`` or less are
    placeholders and don't count) and hands over on the first day of the next contract that has one; the last one
    has no end.  A contract that begins no earlier than a later one is never in front.
    """
    first = days.filter(F.col("n_bytes") > least_bytes).groupBy(*CONTRACT).agg(F.min("day").alias("start"))
    later = Window.partitionBy("root").orderBy("year", "month").rowsBetween(1, Window.unboundedFollowing)
    # a sweep over the beginnings: a contract owns what lies between its own and the first one of any later contract
    spans = first.withColumn("end", F.min("start").over(later))
    return spans.filter(F.isnull("end") | (F.col("start") < F.col("end")))


def front_bars(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """bars (root, year, month, ts, ...) of the contract that is in front at their time: one owner a time, whatever the sources hold, and whether a bar is the first after a seam.

    Spans are a row a contract; they don't overlap, so no two contracts keep bars of one time.
    """
    day = F.to_date("ts")
    own = bars.join(spans, list(CONTRACT)).filter((day >= F.col("start")) & (F.isnull("end") | (day < F.col("end"))))
    before = Window.partitionBy("root").orderBy("ts")
    label = F.col("year") * 100 + F.col("month")
    seam = F.coalesce(label != F.lag(label).over(before), F.lit(False))
    return own.withColumn("seam", seam).drop("start", "end")


def near_seam(bars: DataFrame, within: int = 30) -> DataFrame:
    """bars with whether a seam lies within ``within`` bars before or after: what ``base_rates`` may leave out."""
    w = Window.partitionBy("root").orderBy("ts").rowsBetween(-within, within)
    return bars.withColumn("near_seam", F.max("seam").over(w))
