"""Points as they stand at the end of a series: open price gaps and equal highs and lows, with what has become of them since."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.blocks import first_beyond
from barspark.functions.folds import folded
from barspark.operators.indicators import atr
from barspark.operators.structure import gaps, swings


def open_gaps(bars: DataFrame, min_gap: float = 0.25, min_atr: float = 0.0) -> DataFrame:
    """Every gap with its size in points and ATR, the first later bar that reaches its middle and the share that has been filled, to the end of the series."""
    found = gaps(bars, min_gap, min_atr).withColumn("level", (F.col("top") + F.col("bottom")) / 2).withColumn("up", F.col("direction") == -1)
    rows = first_beyond(found, bars)
    depth = F.when(F.col("up"), F.col("extreme") - F.col("bottom")).otherwise(F.col("top") - F.col("extreme"))
    points = F.col("top") - F.col("bottom")
    fill = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), depth / points)), F.lit(0.0))
    return rows.select("instrument", (F.col("i") - 1).alias("origin"), "i", "direction", "bottom", "top", points.alias("points"), (points / F.when(F.col("atr") > 0, F.col("atr"))).alias("size_atr"), F.col("found_i").alias("mitigated_i"), fill.alias("fill"))


def equal_levels(bars: DataFrame, k: int = 3, lookback: int | None = 120, tick: float = 0.25, near_ticks: float = 4.0, near_atr: float = 0.2) -> DataFrame:
    """Clusters of two or more swings of one kind at one price, as of the last bar, and whether the price has gone beyond since.

    In order, a swing joins the oldest cluster whose mean so far lies within tolerance (of the last bar's ATR), else it
    begins one.  Open clusters stand in order of their means, so a swing looks at those near its price only.  A level is
    known ``k`` bars after its latest swing; from then on the first bar beyond it sweeps it.
    """
    last = atr(bars).groupBy("instrument").agg(F.max("i").alias("last"), F.max_by("atr", "i").alias("unit"))
    near = F.greatest(F.lit(near_ticks * tick), F.when(F.col("unit") > 0, near_atr * F.col("unit")).otherwise(0.0))
    rows = swings(bars, k).join(last.withColumn("near", near), "instrument")
    if lookback is not None:
        rows = rows.filter(F.col("i") >= F.col("last") + 1 - lookback + k)

    def step(state, row):
        instrument, kind, i, price, within = row
        means, clusters = state["means"], state["clusters"]
        at = bisect_left(means, (price - within * (1 + 1e-9) - 1e-9,))
        oldest = None
        while at < len(means) and means[at][0] <= price + within * (1 + 1e-9) + 1e-9:
            mean, number = means[at]
            if abs(price - mean) <= within and (oldest is None or number < oldest):
                oldest = number
            at += 1
        if oldest is None:
            oldest = len(clusters)
            clusters.append((price, 1))
        else:
            total, count = clusters[oldest]
            means.remove((total / count, oldest))
            clusters[oldest] = (total + price, count + 1)
        total, count = clusters[oldest]
        insort(means, (total / count, oldest))
        yield instrument, kind, i, price, oldest

    members = folded(rows.select("instrument", "kind", "i", "price", "near"), ("instrument", "kind"), ("i",), lambda: {"means": [], "clusters": []}, step, "instrument string, kind string, i long, price double, cluster long")
    found = members.groupBy("instrument", "kind", "cluster").agg(F.count("*").alias("members"), F.avg("price").alias("level"), F.min("i").alias("first"), F.max("i").alias("latest")).filter("members > 1")
    known = F.least(F.col("latest") + k, F.col("last")).alias("available")
    found = found.join(last.withColumn("near", near), "instrument").select("instrument", "kind", "members", "level", "first", "latest", known, F.col("near").alias("tolerance"))
    swept = first_beyond(found.withColumn("i", F.col("available") - 1).withColumn("up", F.col("kind") == "high"), bars, strict=True)
    return swept.select("instrument", "kind", "first", "latest", "available", "members", "level", "tolerance", F.col("found_i").isNotNull().alias("swept"), F.col("found_i").alias("swept_i"))
