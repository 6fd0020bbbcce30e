"""What patterns are worth: null lines, placebos, conditions, label joins, overlaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.events import barrier_grid, first_touches
from barspark.sources.bars import series


def null_line(bars: DataFrame, n: int = 200_000, seed: int = 7, **kwargs) -> DataFrame:
    """The barrier grid of bars drawn by a hash of their series and number, each in both directions: what no pattern would do.

    About n bars of the table are drawn, all of a smaller one; the draw is the same on every run and partitioning.
    """
    share = n / max(1, bars.count())
    drawn = bars.filter(F.pmod(F.xxhash64("instrument", "i", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)).select("instrument", "i", F.explode(F.array(F.lit(1).cast("long"), F.lit(-1).cast("long"))).alias("direction"), F.lit("null_line").alias("pattern"))
    return barrier_grid(first_touches(drawn, bars, **kwargs))


def placebo(events: DataFrame, bars_a_day: int, most_days: int = 5, seed: int = 7) -> DataFrame:
    """Each event moved by one to ``most_days`` days, back or on, by a hash of the event; pattern names get a prefix."""
    h = F.xxhash64("instrument", "i", "direction", "pattern", F.lit(seed))
    days = F.pmod(h, F.lit(most_days)) + 1
    back = F.when(F.pmod(F.shiftright(h, 8), F.lit(2)) == 0, -1).otherwise(1)
    moved = events.withColumn("i", F.col("i") + back * days * bars_a_day).withColumn("pattern", F.concat(F.lit("placebo_"), "pattern"))
    return moved.filter("i >= 0")


def pattern_comparison(events: DataFrame, bars: DataFrame, null: DataFrame, least_decided: int = 500) -> DataFrame:
    """Each pattern's barrier grid beside the null line's of the same direction; cells with few decided events are left out."""
    g = barrier_grid(first_touches(events, bars)).filter(F.col("hits") + F.col("losses") >= least_decided)
    base = null.select("direction", "target", "stop", (F.col("hits") / F.nullif(F.col("hits") + F.col("losses"), F.lit(0))).alias("null_share"), F.col("expectancy").alias("null_expectancy"))
    share = F.col("hits") / F.nullif(F.col("hits") + F.col("losses"), F.lit(0))
    return g.withColumn("share", share).join(base, ["direction", "target", "stop"]).withColumn("edge", F.col("expectancy") - F.col("null_expectancy"))


def conditions(bars: DataFrame, named: dict[str, tuple[Column, int]], horizon: int) -> DataFrame:
    """Per named condition (a column and a direction): bars, share won, mean and t of the ends after ``horizon`` bars, against all bars.

    The conditions are unpivoted, so the bars are read once; t is against the mean of all bars in the direction.
    """
    w = series()
    rows = bars.withColumn("_end", F.lead("close", horizon).over(w) - F.lead("open").over(w))
    every = F.array(*(F.struct(F.lit(n).alias("condition"), F.lit(d).cast("long").alias("direction"), F.coalesce(c, F.lit(False)).alias("hit")) for n, (c, d) in named.items()))
    rows = rows.withColumn("c", F.explode(every)).filter("_end is not null").select("c.*", (F.col("c.direction") * F.col("_end")).alias("x"))
    hit = F.when(F.col("hit"), F.col("x"))
    out = rows.groupBy("condition", "direction").agg(F.count(hit).alias("n"), F.avg((hit > 0).cast("double")).alias("won"), F.avg(hit).alias("mean"), F.stddev_samp(hit).alias("sd"), F.avg("x").alias("all_mean"), F.avg((F.col("x") > 0).cast("double")).alias("all_won"))
    return out.withColumn("t", (F.col("mean") - F.col("all_mean")) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)))


def at_bar(rows: DataFrame, bars: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns of the bar of their time; null where there is none."""
    return rows.join(bars.select("instrument", "ts", *columns), ["instrument", "ts"], "left")


def overlapping(a: DataFrame, b: DataFrame, share: float = 0.5, width: int = 64) -> DataFrame:
    """Spans of a (id, instrument, first_i, last_i) and of b that cover more than a share of a's length.

    Spans meet in the blocks of ``width`` bars that they touch, so no ranges are joined.
    """
    in_blocks = lambda rows: rows.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_i") / width), F.floor(F.col("last_i") / width))))
    left = in_blocks(a)
    right = in_blocks(b.select("instrument", F.col("id").alias("other"), "first_i", "last_i")).select("instrument", "_block", "other", F.col("first_i").alias("b_first"), F.col("last_i").alias("b_last"))
    common = F.least("last_i", "b_last") - F.greatest("first_i", "b_first") + 1
    met = left.join(right, ["instrument", "_block"]).filter(common > share * (F.col("last_i") - F.col("first_i") + 1))
    return met.select("instrument", "id", "other").distinct()


def not_judged(found: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """What has not been judged yet."""
    return found.join(judged.select(*keys).distinct(), keys, "left_anti")


def length_matched(windows: DataFrame, bars: DataFrame, seed: int = 7) -> DataFrame:
    """For each span (id, instrument, first_i, last_i) one of the same length at a place drawn by a hash of its id, within the series."""
    sizes = bars.groupBy("instrument").agg(F.count("*").alias("_n"))
    length = F.col("last_i") - F.col("first_i")
    rows = windows.join(sizes, "instrument").filter(F.col("_n") > length)
    start = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_n") - length)
    return rows.select("id", "instrument", start.alias("first_i"), (start + length).alias("last_i"))


def spread_sample(found: DataFrame, n: int, month: str = "month", seed: int = 7) -> DataFrame:
    """n rows of found (with an ``id``), spread evenly over months whatever each holds: an equal share of each, topped up from all where months are short, thinned where shares add up to more."""
    draw = lambda k: F.xxhash64("id", F.lit(seed + k))
    months = found.select(month).distinct().count()
    each = max(1, n // max(1, months))
    rows = found.withColumn("_n", F.row_number().over(Window.partitionBy(month).orderBy(draw(0), "id")))
    # rows within their month's share come first, the others after them, both in an order of their own
    order = (F.col("_n") > each).cast("int"), draw(1), F.col("id")
    return rows.orderBy(*order).limit(n).drop("_n")


def clear_windows(lengths: DataFrame, patterns: DataFrame, bars: DataFrame, n: int, lead: int = 20, most_covered: float = 0.5, most_minutes: float | None = None, tries: int = 16, seed: int = 7) -> DataFrame:
    """n spans (id, instrument, first_i, last_i, bars) with the lengths of given ones (column ``bars``), none overlapping another with its lead, and none of which a single pattern (id, instrument, first_i, last_i) covers more than a share.

    The series are cut into cells that hold the longest span and its lead; every cell holds at most one span, at a place drawn
    in it, so no two meet.  Cells stand in a drawn order and are dealt to the asked spans in turns, with ``tries`` places drawn
    in each; a span takes the first place that is clear.  With ``most_minutes`` a bar, spans across a pause are refused.  Fewer come back only if a
    span's cells are all refused.
    """
    longest = lengths.agg(F.max("bars")).first()[0] or 0
    width = longest + lead + 1
    drawn = lambda *c: F.xxhash64(*c, F.lit(seed))
    asked = lengths.withColumn("_h", drawn("bars", F.monotonically_increasing_id())).orderBy("_h").limit(n).withColumn("id", F.row_number().over(Window.orderBy("_h")) - 1).select("id", "bars")  # n rows
    have = asked.count()
    if not have:
        raise ValueError("no lengths to draw from")
    more = asked.select((F.col("id") + 0).alias("of"), "bars")
    targets = bars.sparkSession.range(n).select("id", (F.col("id") % have).alias("of")).join(F.broadcast(more), "of").select("id", "bars")
    sizes = bars.groupBy("instrument").agg(F.floor((F.max("i") + 1) / width).alias("m")).filter("m > 0")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    if not total:
        raise ValueError("no series holds a span")
    # cells in a drawn order without sorting them: a step that shares no factor with their number goes through all
    step = next(k for k in range(int(total * 0.618) + seed, 2 * total + seed + 2) if math.gcd(k, total) == 1)
    before = F.coalesce(F.sum("m").over(Window.orderBy("instrument").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a series
    cells = sizes.withColumn("before", before).select("instrument", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("cell"))
    order = ((F.col("before") + F.col("cell")) * step + seed) % total
    dealt = cells.select("instrument", "cell", order.alias("order")).withColumn("id", F.col("order") % n).join(F.broadcast(targets), "id").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    start = F.col("cell") * width + lead + F.pmod(drawn("instrument", "cell", "id", "try"), F.lit(width - lead) - F.col("bars"))
    nth = F.struct("order", "try")
    spans = dealt.select("id", nth.alias("nth"), "instrument", start.alias("first_i"), (start + F.col("bars")).alias("last_i"), "bars")
    named = spans.withColumn("target", F.col("id")).withColumn("id", F.col("nth"))
    covered = overlapping(named.select("id", "instrument", "first_i", "last_i"), patterns, most_covered).select("id").distinct()
    clear = named.join(covered, "id", "left_anti")
    if most_minutes is not None:
        ends = bars.select("instrument", F.col("i").alias("_i"), "ts")
        begin, end = ends.toDF("instrument", "first_i", "_begin"), ends.toDF("instrument", "last_i", "_end")
        clear = clear.withColumn("first_i", F.col("first_i") - lead).join(begin, ["instrument", "first_i"]).withColumn("first_i", F.col("first_i") + lead).join(end, ["instrument", "last_i"])
        clear = clear.filter(F.timestamp_diff("SECOND", F.col("_begin"), F.col("_end")) <= 60 * most_minutes * (F.col("bars") + lead))
    best = clear.groupBy("target").agg(F.min_by(F.struct("instrument", "first_i", "last_i", "bars"), "nth").alias("s"))
    return best.select(F.col("target").alias("id"), "s.*")


def as_json(rows: DataFrame, keys: list[str], out: str = "features") -> DataFrame:
    """rows with all columns but the keys as one JSON text."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, F.to_json(F.struct(*rest)).alias(out))


