"""Chart and candle patterns at every bar with a confidence from 0 to 1, and breaks of every swing."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.folds import folded
from barspark.operators.indicators import flag_signals, range_compression
from barspark.operators.levels import LEVEL_NAMES, level_columns
from barspark.operators.structure import displacements, double_patterns, swings
from barspark.operators.structure import gaps as price_gaps
from barspark.sources.bars import series

FOUND = ("instrument", "i", "pattern", "direction", "confidence")
BROKEN = "instrument string, kind string, swing_i long, level double, i long, lower boolean"


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _one(condition: Column, name, direction, confidence: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    direction = F.lit(direction) if isinstance(direction, int) else direction
    return F.when(condition, F.struct(name.alias("pattern"), direction.cast("long").alias("direction"), _clamped(confidence).alias("confidence")))


def _flag() -> Column:
    ratio = F.abs(F.col("flag_impulse")) / F.nullif("flag_range", F.lit(0.0))
    broke = F.col("flag_up") | F.col("flag_down")
    direction = F.when(F.col("flag_up"), 1).when(F.col("flag_down"), -1).otherwise(F.col("flag_direction"))
    known = (F.col("flag_direction") != 0) & (F.col("flag_range") > 0) & (broke | F.col("flag_forming"))
    return _one(known, F.when(broke, "flag_breakout").otherwise("flag_forming"), direction, 0.5 + 0.1 * (ratio - 2))


def _triangle(back: int, flat_atr: float) -> Column:
    """From the last two swings of either kind, none farther back than ``back`` bars: which of the sides are flat or close in."""
    recent = (F.col("i") - F.col("high_before_origin") < back) & (F.col("i") - F.col("low_before_origin") < back)
    near = flat_atr * F.coalesce("atr", F.lit(0.0))
    top, bottom = F.col("swing_high") - F.col("high_before"), F.col("swing_low") - F.col("low_before")
    falling, rising = top < -near, bottom > near
    name = F.when(falling & rising, "triangle_symmetric").when((F.abs(top) <= near) & rising, "triangle_ascending").when(falling & (F.abs(bottom) <= near), "triangle_descending")
    direction = F.when(name == "triangle_ascending", 1).when(name == "triangle_descending", -1).otherwise(0)
    before = F.col("high_before") - F.col("low_before")
    return _one(recent & name.isNotNull() & (before > 0), name, direction, 1.5 * (1 - (F.col("swing_high") - F.col("swing_low")) / before))


def patterns(bars: DataFrame, ticks: DataFrame, back: int = 120, flat_atr: float = 0.3, near_atr: float = 0.35, most_compressed: float = 0.6) -> DataFrame:
    """(instrument, i, pattern, direction, confidence): flags, triangles, compression, double patterns and, at bars near a level, engulfing and pin bars."""
    rows = range_compression(flag_signals(level_columns(bars, ticks)))
    for c in ("open", "close"):
        rows = rows.withColumn(f"_{c}", F.lag(c).over(series()))
    body, before = F.abs(F.col("close") - F.col("open")), F.abs(F.col("_close") - F.col("_open"))
    span, upper, lower = F.col("high") - F.col("low"), F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    nearest = F.array_min(F.array(*(F.abs(F.col(n) - F.col("close")) for n in LEVEL_NAMES)))
    at_level = (F.col("atr") > 0) & (nearest <= near_atr * F.col("atr"))
    rising, rose = F.col("close") > F.col("open"), F.col("_close") > F.col("_open")
    engulfing = at_level & (before > 0) & (body > before) & (rising != rose) & (F.least("open", "close") <= F.least("_open", "_close")) & (F.greatest("open", "close") >= F.greatest("_open", "_close"))
    pin = at_level & (span > 0) & (body > 0)
    below, above = pin & (lower >= 2 * body) & (lower >= 0.5 * span), pin & (upper >= 2 * body) & (upper >= 0.5 * span)
    ratio = F.col("range_now") / F.nullif("range_usual", F.lit(0.0))
    found = F.array_compact(F.array(
        _flag(), _triangle(back, flat_atr), _one(ratio <= most_compressed, "compression", 0, 1 - ratio / most_compressed),
        _one(engulfing, "engulfing", F.when(rising, 1).otherwise(-1), 0.3 + 0.15 * (body / F.nullif(before, F.lit(0.0)) - 1)),
        F.coalesce(_one(below, "pin_bar", 1, 0.25 + 0.1 * (lower / F.nullif(body, F.lit(0.0)) - 2)), _one(above, "pin_bar", -1, 0.25 + 0.1 * (upper / F.nullif(body, F.lit(0.0)) - 2))),
    ))
    rows = rows.select("instrument", "i", F.explode(found).alias("p")).select("instrument", "i", "p.*")
    doubles = double_patterns(bars).select("instrument", F.col("available").alias("i"), "pattern", F.when(F.col("pattern") == "double_bottom", 1).otherwise(-1).cast("long").alias("direction"), "confidence")
    return rows.select(*FOUND).unionByName(doubles)


def ranked(found: DataFrame) -> DataFrame:
    """Patterns of each bar by confidence, the surest first."""
    order = Window.partitionBy("instrument", "i").orderBy(F.desc("confidence"), "pattern", "direction")
    return found.withColumn("rank", F.row_number().over(order).cast("long"))


def swing_breaks(bars: DataFrame, k: int = 3) -> DataFrame:
    """For every swing the first close beyond it after it is known, however much later: bos, or choch where it lay inside the swing just before it, mss if a displacement or gap comes with the break.

    A fold over the series holds the swings not broken yet, by price.
    """
    order = Window.partitionBy("instrument").orderBy("i", "kind")
    known = swings(bars, k).withColumn("_kind", F.lag("kind").over(order)).withColumn("_price", F.lag("price").over(order))
    inside = F.when(F.col("kind") == "high", F.col("price") < F.col("_price")).otherwise(F.col("price") > F.col("_price"))
    known = known.select("instrument", F.col("available").alias("i"), F.lit(1).alias("what"), "kind", F.col("i").alias("swing_i"), "price", F.coalesce((F.col("kind") == F.col("_kind")) & inside, F.lit(False)).alias("lower"))
    closes = bars.select("instrument", "i", F.lit(0).alias("what"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("swing_i"), F.col("close").alias("price"), F.lit(False).alias("lower"))

    def step(state, row):
        instrument, i, what, kind, swing_i, price, lower = row
        if what:
            sign = 1 if kind == "high" else -1
            heapq.heappush(state[kind], (sign * price, swing_i, lower))
            return
        for side, sign in (("high", 1), ("low", -1)):
            held = state[side]
            while held and held[0][0] < sign * price:
                level, at, inner = heapq.heappop(held)
                yield instrument, side, at, sign * level, i, inner

    # a bar's close comes before the swings that are known with it
    broken = folded(closes.unionByName(known), ("instrument",), ("i", "what", "kind"), lambda: {"high": [], "low": []}, step, BROKEN)
    direction = F.when(F.col("kind") == "high", 1).otherwise(-1).cast("long")
    moves = displacements(bars).select("instrument", "i", "direction", F.lit(True).alias("displacement"))
    gaps = price_gaps(bars).select("instrument", "i", "direction", F.lit(True).alias("gap"))
    rows = broken.withColumn("direction", direction).join(moves, ["instrument", "i", "direction"], "left").join(gaps, ["instrument", "i", "direction"], "left")
    rows = rows.withColumn("displacement", F.coalesce("displacement", F.lit(False))).withColumn("gap", F.coalesce("gap", F.lit(False)))
    kind = F.when(~F.col("lower"), "bos").when(F.col("displacement") | F.col("gap"), "mss").otherwise("choch")
    return rows.select("instrument", "swing_i", "level", "i", "direction", kind.alias("break_type"), "displacement", "gap")
