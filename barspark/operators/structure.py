"""Market structure over bar series.  Nothing is known before it is available: a swing of strength k at bar p counts from p + k."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.blocks import Ahead, Bars, extreme_around, in_blocks
from barspark.functions.folds import folded
from barspark.functions.rolling import between, filled, lagged, with_ahead
from barspark.operators.indicators import atr
from barspark.sources.bars import series


def _is_swing(k: int) -> tuple:
    high = (F.col("high") > between(F.max, "high", -k, -1)) & (F.col("high") >= between(F.max, "high", 1, k))
    low = (F.col("low") < between(F.min, "low", -k, -1)) & (F.col("low") <= between(F.min, "low", 1, k))
    return high, low


def swings(bars: DataFrame, k: int = 3) -> DataFrame:
    """One row a swing: instrument, kind, i, ts, price, available (i + k). Strictly beyond the k bars before, at least as far as the k after."""

    def found(block: Bars) -> dict:
        parts = []
        for kind in ("high", "low"):
            at = np.flatnonzero(extreme_around(block[kind], k, low=kind == "low")[block.own]) + block.own.start
            parts.append({"kind": np.full(len(at), kind, object), "i": block.i[at], "ts": block["ts"][at], "price": block[kind][at], "available": block.i[at] + k})
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    return in_blocks(bars, ("ts", "high", "low"), k, k, found, f"instrument string, kind string, i long, ts {dict(bars.dtypes)['ts']}, price double, available long")


def with_last_swings(bars: DataFrame, k: int = 3) -> DataFrame:
    """The latest and second latest available swing of either kind, price and origin, at every bar; labels and trend too."""
    high, low = _is_swing(k)
    rows = bars.withColumn("_high", F.when(high, F.col("high"))).withColumn("_low", F.when(low, F.col("low")))
    past, names = series().rowsBetween(Window.unboundedPreceding, -1), []
    for kind in ("high", "low"):
        price, before = F.col(f"_{kind}"), F.last(f"_{kind}", ignorenulls=True).over(past)
        before_origin = F.last(F.when(price.isNotNull(), F.col("i")), ignorenulls=True).over(past)
        label = F.when(before.isNotNull(), F.concat(F.when(price > before, "H").otherwise("L"), F.lit(kind[0].upper())))
        rows = rows.withColumn(f"_{kind}", F.when(price.isNotNull(), F.struct(price.alias("price"), F.col("i").alias("origin"), label.alias("label"), before.alias("before"), before_origin.alias("before_origin"))))
        names += [(f"_{kind}", c, f"{kind}_{c}") for c in ("price", "origin", "label", "before", "before_origin")]
    # a swing is known k bars on
    rows = rows.withColumn("_high", F.lag("_high", k).over(series())).withColumn("_low", F.lag("_low", k).over(series()))
    rows = rows.withColumn("_high", filled("_high")).withColumn("_low", filled("_low"))
    out = rows.select("*", *(F.col(f"{s}.{c}").alias(n) for s, c, n in names)).drop("_high", "_low")
    flip = F.when((F.col("high_label") == "HH") & (F.col("low_label") == "HL"), 1).when((F.col("high_label") == "LH") & (F.col("low_label") == "LL"), -1)
    return out.withColumn("_flip", flip).withColumn("trend", F.coalesce(filled("_flip"), F.lit(0)).cast("long")).drop("_flip")


def structure_breaks(bars: DataFrame, k: int = 3, reach: float = 0.05) -> DataFrame:
    """Closes beyond the last swing by reach * ATR, once a swing: BOS with the trend (or none), CHoCH against it."""
    rows = with_last_swings(atr(bars), k)
    rows = rows.withColumn("_trend", F.lag("trend").over(series()))
    side = lambda d, kind: F.struct(F.lit(d).cast("long").alias("direction"), F.col(f"{kind}_origin").alias("origin"), F.col(f"{kind}_price").alias("level"))
    up = F.when(F.col("close") > F.col("high_price") + reach * F.col("atr"), side(1, "high"))
    down = F.when(F.col("close") < F.col("low_price") - reach * F.col("atr"), side(-1, "low"))
    events = rows.select("instrument", "i", F.coalesce("_trend", F.lit(0)).alias("trend"), F.explode(F.array_compact(F.array(up, down))).alias("e")).select("instrument", "i", "e.*", "trend")
    first = Window.partitionBy("instrument", "direction", "origin").orderBy("i")
    events = events.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return events.withColumn("variant", F.when(F.col("trend") * F.col("direction") >= 0, "bos").otherwise("choch"))


def gaps(bars: DataFrame, min_gap: float = 0.25, min_atr: float = 0.0) -> DataFrame:
    """Gaps of ``min_gap`` at least between a bar and the one two before: instrument, i, direction, bottom, top, atr."""
    rows = atr(bars).withColumn("_h", lagged("high", 2)).withColumn("_l", lagged("low", 2))
    up, down = F.col("low") - F.col("_h"), F.col("_l") - F.col("high")
    wide = lambda x: (x > 0) & (x >= min_gap)
    rows = rows.withColumn("direction", F.when(wide(up), 1).when(wide(down), -1).cast("long")).filter("direction is not null")
    rising = F.col("direction") == 1
    rows = rows.withColumn("bottom", F.when(rising, F.col("_h")).otherwise(F.col("high"))).withColumn("top", F.when(rising, F.col("low")).otherwise(F.col("_l")))
    if min_atr > 0:
        rows = rows.filter(F.isnull("atr") | (F.col("atr") <= 0) | (F.col("top") - F.col("bottom") >= min_atr * F.col("atr")))
    return rows.select("instrument", "i", "direction", "bottom", "top", "atr")


def fair_value_gaps(bars: DataFrame, min_gap: float = 0.25, horizon: int = 240) -> DataFrame:
    """Gaps of ``min_gap`` at least between a bar and the one two before: origin i - 1, available i.

    mitigated_after and fill look at the next ``horizon`` bars; they are outcomes, not features.
    """

    def found(block: Bars) -> dict:
        high, low = block["high"], block["low"]
        at = np.arange(block.own.start, block.own.stop)
        at = at[block.i[at] >= 2]
        up, down = low[at] - high[at - 2], low[at - 2] - high[at]
        side = np.where((up > 0) & (up >= min_gap), 1, np.where((down > 0) & (down >= min_gap), -1, 0))
        at, side = at[side != 0], side[side != 0]
        bottom, top = np.where(side == 1, high[at - 2], high[at]), np.where(side == 1, low[at], low[at - 2])
        after, fill = np.full(len(at), np.nan), np.full(len(at), np.nan)
        for d, name in ((1, "low"), (-1, "high")):
            own = np.flatnonzero(side == d)
            ahead, start = Ahead(block[name], low=d == 1), at[own] + 1
            steps = ahead.first(start, ((top + bottom) / 2)[own]) - at[own]
            after[own] = np.where((steps <= horizon) & (at[own] + steps < len(block)), steps, np.nan)
            far = ahead.extreme(start, start + horizon)
            depth = top[own] - far if d == 1 else far - bottom[own]
            fill[own] = np.clip(depth / (top[own] - bottom[own]), 0.0, 1.0)
        return {"i": block.i[at], "origin": block.i[at] - 1, "direction": side, "bottom": bottom, "top": top, "mitigated_after": after, "fill": fill}

    return in_blocks(bars, ("high", "low"), 2, horizon, found, "instrument string, i long, origin long, direction long, bottom double, top double, mitigated_after long, fill double")


def displacements(bars: DataFrame, body_ratio: float = 0.6, body_atr: float = 1.0, volume: float = 1.0) -> DataFrame:
    """Bars with a large body: of its range, of ATR (where known) and with volume not under its 20-bar mean."""
    rows = atr(bars)
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    mean = F.avg("volume").over(series().rowsBetween(-19, 0))
    rows = rows.withColumn("_mean", mean).filter((span > 0) & (body / span >= body_ratio) & (F.col("atr").isNull() | (body >= body_atr * F.col("atr"))) & (F.col("volume") >= volume * F.col("_mean")))
    return rows.select("instrument", "i", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).cast("long").alias("direction"), (body / span).alias("body_ratio"), F.col("atr"))


def order_blocks(bars: DataFrame, back: int = 10) -> DataFrame:
    """The last bar of the other colour within ``back`` bars before a displacement; a bar that closes where it opens has no colour."""
    w = series().rowsBetween(-back, -1)
    box = F.struct("i", "high", "low")
    rows = bars.withColumn("_red", F.last(F.when(F.col("close") < F.col("open"), box), ignorenulls=True).over(w)).withColumn("_green", F.last(F.when(F.col("close") > F.col("open"), box), ignorenulls=True).over(w))
    found = displacements(bars).select("instrument", "i", "direction").join(rows.select("instrument", "i", "_red", "_green"), ["instrument", "i"])
    block = F.when(F.col("direction") == 1, F.col("_red")).otherwise(F.col("_green"))
    return found.withColumn("b", block).filter("b is not null").select("instrument", "i", "direction", F.col("b.i").alias("origin"), F.col("b.high").alias("top"), F.col("b.low").alias("bottom"))


def with_order_blocks(bars: DataFrame) -> DataFrame:
    """bars with the latest order block of either direction, as it was known: bull_top, bull_bottom, bear_top, bear_bottom."""
    found = order_blocks(bars).withColumn("side", F.when(F.col("direction") == 1, "bull").otherwise("bear"))
    wide = found.groupBy("instrument", "i").pivot("side", ["bull", "bear"]).agg(F.first("top").alias("top"), F.first("bottom").alias("bottom"))
    rows = bars.join(wide, ["instrument", "i"], "left")
    for c in ("bull_top", "bull_bottom", "bear_top", "bear_bottom"):
        rows = rows.withColumn(c, filled(c))
    return rows


def tradable_bottoms(bars: DataFrame, k: int = 3, most_bars: int = 60, green: int = 2) -> DataFrame:
    """Swing lows that hold until ``green`` bars in a row close higher than they open, within ``most_bars`` bars after the low is known: the entry is the next bar's open, the stop the low.

    A bar that trades under the low first ends the search.
    """
    lows = swings(bars, k).filter("kind = 'low'").select("instrument", F.col("i").alias("low_i"), F.col("price").alias("stop"), F.col("available").alias("i"))
    rows = with_ahead(lows, bars, most_bars + 1, ("open", "low", "close"))
    up = F.zip_with("ahead_open", "ahead_close", lambda o, c: c > o)
    # where the last of the bars in a row stands
    run = F.transform(F.sequence(F.lit(1), F.size("ahead_open")), lambda at: (at >= green) & F.forall(F.slice(up, F.greatest(F.lit(1), at - green + 1), F.lit(green)), lambda x: x))
    rows = rows.filter(F.size("ahead_open") > green).withColumn("_at", F.array_position(run, True).cast("int"))
    broken = F.array_position(F.transform("ahead_low", lambda x: x < F.col("stop")), True)
    rows = rows.filter((F.col("_at") > 0) & (F.col("_at") < F.size("ahead_open")) & (F.col("_at") <= most_bars) & ((broken == 0) | (broken > F.col("_at"))))
    return rows.select("instrument", "low_i", "stop", (F.col("i") + F.col("_at")).alias("signal_i"), F.get("ahead_open", F.col("_at")).alias("entry"))


def liquidity_sweeps(levels: DataFrame, bars: DataFrame, reclaim: int = 3, min_atr: float = 0.05) -> DataFrame:
    """Levels (of ``levels.levels_long``) pierced and reclaimed, by side.

    A bar pierces where its extreme goes beyond and that of the bar before doesn't; the level is reclaimed by the
    first close back within ``reclaim`` later bars; the depth is the extreme of the bars until then.  After a sweep
    that counts, its side is closed until the bar after its reclaim.
    """
    above = (F.col("high") > F.col("level")) & (F.col("prev_high") <= F.col("level"))
    below = (F.col("low") < F.col("level")) & (F.col("prev_low") >= F.col("level"))
    sides = F.array_compact(F.array(F.when(above, F.lit(-1).cast("long")), F.when(below, F.lit(1).cast("long"))))
    # the piercing bar is the first one looked at
    rows = levels.select("instrument", (F.col("i") - 1).alias("i"), "name", "level", "atr", F.explode(sides).alias("direction"))
    rows = with_ahead(rows, bars, reclaim + 1, ("high", "low", "close"))
    down = F.col("direction") == -1
    back = F.array_position(F.transform("ahead_close", lambda x: F.when(down, x < F.col("level")).otherwise(x > F.col("level"))), True).cast("int")
    rows = rows.withColumn("_at", back).filter(F.col("_at") > 0)
    extreme = F.when(down, F.array_max(F.slice("ahead_high", F.lit(1), F.col("_at")))).otherwise(F.array_min(F.slice("ahead_low", F.lit(1), F.col("_at"))))
    rows = rows.withColumn("depth", F.abs(extreme - F.col("level"))).filter(F.col("depth") >= min_atr * F.col("atr"))
    rows = rows.select("instrument", "name", "direction", (F.col("i") + 1).alias("origin"), (F.col("i") + F.col("_at")).alias("i"), "level", "depth")

    def step(state, row):
        if row[3] > state["until"]:
            state["until"] = row[4]
            yield row

    return folded(rows, ("instrument", "name", "direction"), ("origin",), lambda: {"until": -1}, step, rows.schema)


def double_patterns(bars: DataFrame, k: int = 3, most_bars: int = 120, near_atr: float = 0.5, deep_atr: float = 1.0, break_within: int = 24) -> DataFrame:
    """Consecutive swings of one kind at about one price with an opposite swing strictly between, deep enough; the neck there, and the first close beyond it.

    What depends on ATR takes the one at the bar where the second swing is known.
    """
    high, low = _is_swing(k)
    rows = atr(bars).withColumn("_high", F.when(high, F.col("high"))).withColumn("_low", F.when(low, F.col("low"))).withColumn("_atr", F.lead("atr", k).over(series()))
    past, found = series().rowsBetween(Window.unboundedPreceding, -1), []
    for kind, other, extreme in (("low", "high", F.max), ("high", "low", F.min)):
        own = F.when(F.col(f"_{kind}").isNotNull(), F.struct("i", F.col(f"_{kind}").alias("price")))
        rows = rows.withColumn(f"_n_{kind}", F.count(f"_{kind}").over(past)).withColumn(f"_last_{kind}", F.last(own, ignorenulls=True).over(past))
        # bars with one number of swings before them: those from the last one to this one
        between_two = Window.partitionBy("instrument", f"_n_{kind}").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(f"_neck_{kind}", extreme(f"_{other}").over(between_two))
        found.append(F.when(F.col(f"_{kind}").isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(f"_last_{kind}.i").alias("first_i"), F.col(f"_last_{kind}.price").alias("first_price"), F.col(f"_{kind}").alias("price"), F.col(f"_neck_{kind}").alias("neck"))))
    rows = rows.select("instrument", "i", "_atr", F.explode(F.array_compact(F.array(*found))).alias("p")).select("instrument", "i", "_atr", "p.*").filter(F.col("_atr") > 0)
    apart, depth = F.abs(F.col("price") - F.col("first_price")), F.abs((F.col("price") + F.col("first_price")) / 2 - F.col("neck"))
    rows = rows.filter((F.col("i") - F.col("first_i") <= most_bars) & (apart <= near_atr * F.col("_atr")) & (depth >= deep_atr * F.col("_atr")))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    confidence = clamp(0.4 * (1 - apart / (near_atr * F.col("_atr"))) + 0.6 * clamp(depth / (2 * deep_atr * F.col("_atr"))))
    rows = rows.withColumn("confidence", confidence).withColumn("available", F.col("i") + k).withColumn("swing_i", F.col("i"))
    # the bar at which the pattern is known is the first one that can close beyond the neck
    rows = with_ahead(rows.withColumn("i", F.col("available") - 1), bars, break_within + 1, ("close",))
    beyond = F.array_position(F.transform("ahead_close", lambda x: F.when(F.col("kind") == "low", x > F.col("neck")).otherwise(x < F.col("neck"))), True)
    return rows.select(
        "instrument", F.when(F.col("kind") == "low", "double_bottom").otherwise("double_top").alias("pattern"), "first_i", F.col("swing_i").alias("i"), "available", "first_price", "price", "neck", "confidence",
        F.when(beyond > 0, F.col("available") + beyond - 1).alias("break_i"),
    )


def zones(bars: DataFrame, k: int = 3, width_atr: float = 0.5, per_side: int = 3, lookback: int = 120) -> DataFrame:
    """Support and resistance as of the last bar: prices of the swings of strength k in the last ``lookback`` bars, below and above the close apart, chained by gaps of at most width_atr * ATR; the nearest few on either side.

    A zone stands at the mean of its prices; ``touches`` counts them, ``bars_since`` is how long ago the latest is.
    A swing at the very close belongs to neither side.
    """
    last = atr(bars).groupBy("instrument").agg(F.max_by("close", "i").alias("now"), F.max_by("atr", "i").alias("unit"), F.max("i").alias("last"))
    rows = swings(bars, k).join(last, "instrument").filter((F.col("i") >= F.col("last") + 1 - lookback + k) & (F.col("price") != F.col("now")))
    rows = rows.withColumn("near", F.when(F.col("unit") > 0, width_atr * F.col("unit")).otherwise(0.0005 * F.abs("now"))).withColumn("side", F.when(F.col("price") < F.col("now"), "support").otherwise("resistance"))
    w = Window.partitionBy("instrument", "side").orderBy("price", "i", "kind")
    fresh = F.coalesce((F.col("price") - F.lag("price").over(w) > F.col("near")).cast("int"), F.lit(0))
    rows = rows.withColumn("_fresh", fresh).withColumn("zone", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("instrument", "side", "zone", "now", "unit", "last").agg(F.avg("price").alias("price"), F.min("price").alias("bottom"), F.max("price").alias("top"), F.count("*").alias("touches"), F.max("i").alias("_i"))
    out = out.withColumn("distance", F.abs(F.col("price") - F.col("now"))).withColumn("distance_atr", F.when(F.col("unit") > 0, F.col("distance") / F.col("unit"))).withColumn("bars_since", F.col("last") - F.col("_i"))
    near = Window.partitionBy("instrument", "side").orderBy("distance", "bottom")
    out = out.withColumn("rank", F.row_number().over(near).cast("long")).filter(F.col("rank") <= per_side)
    return out.select("instrument", "side", "rank", "price", "bottom", "top", "touches", "bars_since", "distance", "distance_atr")


def trend(bars: DataFrame, slope_bars: int = 10, flat: float = 0.02) -> DataFrame:
    """bars with the slope of the 20-bar mean a bar, in points and in ATR, the side of the 50-bar mean, and what they say together.

    ``trend`` is up or down where both agree, else sideways, and null while either is unknown; ``basis`` tells the cases of
    sideways apart: flat, or mixed (the mean moves one way and the price stands on the other side).
    """
    rows = atr(bars).withColumn("_s", between(F.avg, "close", -19, 0)).withColumn("_m", between(F.avg, "close", -49, 0))
    rows = rows.withColumn("slope_points", (F.col("_s") - F.lag("_s", slope_bars).over(series())) / slope_bars)
    rows = rows.withColumn("slope", F.col("slope_points") / F.when(F.col("atr") > 0, F.col("atr"))).withColumn("above", F.col("close") > F.col("_m"))
    rising, falling = F.col("slope") > flat, F.col("slope") < -flat
    known = F.col("slope").isNotNull() & F.col("_m").isNotNull()
    state = F.when(known & rising & F.col("above"), "up").when(known & falling & ~F.col("above"), "down").when(known, "sideways")
    basis = F.when(known & ~rising & ~falling, "flat").when(known & (rising != F.col("above")), "mixed").when(known, "agreed").otherwise("unknown")
    return rows.withColumn("trend", state).withColumn("basis", basis).drop("_s", "_m", "tr")
