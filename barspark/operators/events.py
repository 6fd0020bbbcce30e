"""What follows events: forward outcomes, first touches, clusters, non-overlapping picks and base rates.

An event has instrument, i (the bar at which it is available), direction, pattern and variant.  Entry is the next
bar's open; windows start there, and events whose window is not complete are left out, never cut short.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.blocks import Ahead, Bars, at_events
from barspark.functions.folds import folded
from barspark.functions.quantiles import exact_quantiles
from barspark.functions.rolling import with_ahead
from barspark.functions.stored import stored
from barspark.operators.indicators import atr
from barspark.operators.levels import levels_long
from barspark.operators.research import equal_extremes, t_p_value
from barspark.operators.structure import displacements, gaps, liquidity_sweeps, order_blocks, structure_breaks

HORIZONS = (1, 3, 5, 10, 20, 30, 60, 120, 240)
#: Targets and stops in ATR; fixed.
MULTIPLES = (0.5, 1.0, 1.5, 2.0, 3.0)
MIN_ATR = 1.0
R_LIMIT = 25.0
LEAST_N = 30
SOLID_N = 200
INTERACTIONS = "instrument string, name string, origin long, i long, kind string, direction long, tests long"


def level_interactions(levels: DataFrame, tolerance: float = 0.1, break_atr: float = 0.1, false_within: int = 20, retest_within: int = 60) -> DataFrame:
    """Tests, breaks, false breaks and retests of each level (of ``levels.levels_long``), in order over the series.

    A side is established by a close farther from the level than tolerance and buffer; a close beyond the buffer on
    the other side is a break.  A close back beyond the broken level within ``false_within`` bars is a false break, of
    the opposite direction; the first touch within ``retest_within`` bars that closes on the new side is a retest.
    Touches that close within the buffer are tests, numbered until a break or ``retest_within`` quiet bars.
    """

    def start() -> dict:
        return {"side": 0, "broken": None, "retested": False, "tests": 0, "tested": -(10**9)}

    def step(s: dict, row: tuple):
        instrument, name, i, high, low, close, before, unit, level = row
        near, buffer = tolerance * unit, break_atr * unit
        if s["broken"]:
            at, side, price = s["broken"]
            if i - at <= false_within and side * (price - close) > buffer:
                yield instrument, name, at, i, "false_break", -side, None
                s.update(broken=None, retested=False, side=-side)
            elif i - at > retest_within:
                s.update(broken=None, retested=False)
            elif not s["retested"] and low <= price + near and high >= price - near and side * (close - price) > 0:
                yield instrument, name, at, i, "retest", side, None
                s["retested"] = True
        beyond = 1 if close > level + buffer else -1 if close < level - buffer else 0
        if beyond and s["side"] == -beyond:
            yield instrument, name, i, i, "break", beyond, s["tests"]
            s.update(broken=(i, beyond, level), retested=False, tests=0, side=beyond)
        elif not beyond and low <= level + near and high >= level - near:
            s.update(tests=1 if i - s["tested"] > retest_within else s["tests"] + 1, tested=i)
            yield instrument, name, i, i, "test", 1 if s["side"] == 1 or (s["side"] == 0 and before > level) else -1, s["tests"]
        if abs(close - level) > max(near, buffer):
            s["side"] = 1 if close > level else -1

    rows = levels.select("instrument", "name", "i", "high", "low", "close", "prev_close", "atr", "level")
    return folded(rows, ("instrument", "name"), ("i",), start, step, INTERACTIONS)


def detected(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """Events of all seven detectors: instrument, origin, i, direction, pattern, variant.

    Bars with their ATR and the levels at them are written once for all detectors, and so are the events for whoever reads them.
    """
    bars = stored(atr(bars))
    levels = stored(levels_long(bars, ticks))
    none = F.lit("")
    parts = [
        structure_breaks(bars).withColumn("pattern", F.col("variant")).withColumn("variant", none),
        gaps(bars).withColumn("origin", F.col("i") - 1).select("instrument", "origin", "i", "direction", F.lit("fair_value_gap").alias("pattern"), none.alias("variant")),
        displacements(bars).select("instrument", F.col("i").alias("origin"), "i", "direction", F.lit("displacement").alias("pattern"), none.alias("variant")),
        order_blocks(bars).select("instrument", "origin", "i", "direction", F.lit("order_block").alias("pattern"), none.alias("variant")),
        equal_extremes(bars).select("instrument", F.col("first").alias("origin"), F.col("available").alias("i"), F.when(F.col("kind") == "high", -1).otherwise(1).cast("long").alias("direction"), F.concat(F.lit("equal_"), "kind", F.lit("s")).alias("pattern"), F.concat(F.lit("n"), F.col("members").cast("string")).alias("variant")),
        level_interactions(levels).select("instrument", "origin", "i", "direction", F.concat(F.lit("level_"), "kind").alias("pattern"), F.col("name").alias("variant")),
        liquidity_sweeps(levels, bars).select("instrument", "origin", "i", "direction", F.lit("sweep").alias("pattern"), F.col("name").alias("variant")),
    ]
    columns = ("instrument", "origin", "i", "direction", "pattern", "variant")
    out = parts[0].select(*columns)
    for x in parts[1:]:
        out = out.unionByName(x.select(*columns))
    return stored(out)


def outcomes(events: DataFrame, bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Best and worst excursion and end of each event and complete horizon, in points and in ATR (null without one)."""
    rows = events.join(atr(bars).select("instrument", "i", "atr"), ["instrument", "i"])
    rows = with_ahead(rows, bars, max(horizons), ("open", "high", "low", "close"))
    rows = rows.withColumn("entry", F.get("ahead_open", 0)).withColumn("horizon", F.explode(F.array(*(F.lit(h).cast("long") for h in horizons)))).filter(F.size("ahead_open") >= F.col("horizon"))
    n = F.col("horizon").cast("int")
    rows = rows.withColumn("_h", F.slice("ahead_high", F.lit(1), n)).withColumn("_l", F.slice("ahead_low", F.lit(1), n)).withColumn("_end", F.get("ahead_close", n - 1))
    rows = rows.withColumn("_top", F.array_max("_h")).withColumn("_bottom", F.array_min("_l"))
    top_at, bottom_at = F.array_position("_h", F.col("_top")), F.array_position("_l", F.col("_bottom"))
    long = F.col("direction") == 1
    mfe = F.greatest(F.lit(0.0), F.when(long, F.col("_top") - F.col("entry")).otherwise(F.col("entry") - F.col("_bottom")))
    mae = F.greatest(F.lit(0.0), F.when(long, F.col("entry") - F.col("_bottom")).otherwise(F.col("_top") - F.col("entry")))
    end = F.when(F.col("_end") == F.col("entry"), 0.0).otherwise(F.col("direction") * (F.col("_end") - F.col("entry")))
    r = F.when(F.col("atr") > 0, F.col("atr"))
    return rows.select(
        *events.columns, "horizon", "entry", "atr", mfe.alias("mfe"), mae.alias("mae"), end.alias("end_points"),
        F.when(long, top_at).otherwise(bottom_at).alias("mfe_at"), F.when(long, bottom_at).otherwise(top_at).alias("mae_at"),
        (mfe / r).alias("mfe_r"), (mae / r).alias("mae_r"), (end / r).alias("end_r"),
    )


def first_touches(events: DataFrame, bars: DataFrame, horizon: int = 240, multiples=MULTIPLES) -> DataFrame:
    """Per event and multiple of ATR: after how many bars, the entry bar being 1, the target and the stop are first touched.

    Each bar with an event is looked at once, for all multiples on both sides, whatever the number of its events.
    """
    starts = events.select("instrument", "i").distinct().join(atr(bars).select("instrument", "i", "atr"), ["instrument", "i"]).filter(F.col("atr") >= MIN_ATR)

    def touched(block: Bars, given: pa.Table, at: np.ndarray) -> dict:
        whole = at + horizon < len(block)
        at, unit = at[whole], given.column("atr").to_numpy()[whole]
        entry, tops, bottoms = block["open"][at + 1], Ahead(block["high"]), Ahead(block["low"], low=True)
        parts = {"i": [], "multiple": [], "above": [], "below": []}
        for m in multiples:
            above, below = tops.first(at + 1, entry + m * unit) - at, bottoms.first(at + 1, entry - m * unit) - at
            values = (block.i[at], np.full(len(at), m), np.where(above <= horizon, above, np.nan), np.where(below <= horizon, below, np.nan))
            for c, x in zip(parts, values, strict=True):
                parts[c].append(x)
        return {c: np.concatenate(x) for c, x in parts.items()}

    touches = at_events(starts, bars, ("open", "high", "low"), 0, horizon + 1, touched, "instrument string, i long, multiple double, above long, below long")
    rows = events.select("instrument", "i", "direction", "pattern").join(touches, ["instrument", "i"])
    long = F.col("direction") == 1
    return rows.select("instrument", "i", "direction", "pattern", "multiple", F.when(long, F.col("above")).otherwise(F.col("below")).alias("target_at"), F.when(long, F.col("below")).otherwise(F.col("above")).alias("stop_at"))


def barrier_grid(touches: DataFrame) -> DataFrame:
    """Targets against stops: what is touched first wins, a tie is the stop's and counted as ambiguous."""
    by = ("instrument", "i", "direction", "pattern")
    each = touches.dropDuplicates(["instrument", "i", "direction", "pattern", "multiple"]).groupBy(*by).agg(F.collect_list(F.struct("multiple", "target_at", "stop_at")).alias("m"))  # as many as there are multiples
    rows = each.withColumn("t", F.explode("m")).withColumn("s", F.explode("m")).select(*by, F.col("t.multiple").alias("target"), F.col("s.multiple").alias("stop"), "t.target_at", "s.stop_at")
    hit = F.col("target_at").isNotNull() & (F.col("stop_at").isNull() | (F.col("target_at") < F.col("stop_at")))
    lost = F.col("stop_at").isNotNull() & (F.col("target_at").isNull() | (F.col("stop_at") <= F.col("target_at")))
    out = rows.groupBy("pattern", "direction", "target", "stop").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(lost).alias("losses"), F.count_if(F.col("target_at") == F.col("stop_at")).alias("ambiguous"))
    return out.withColumn("expectancy", (F.col("hits") * F.col("target") - F.col("losses") * F.col("stop")) / F.nullif(F.col("hits") + F.col("losses"), F.lit(0)))


def clusters(events: DataFrame, reach: int = 3) -> DataFrame:
    """Events of one direction within ``reach`` bars of a cluster's first one share its id; the next one further on starts a new one."""
    names = events.columns
    at = names.index("i")

    def step(state, row):
        if state["anchor"] is None or row[at] - state["anchor"] > reach:
            state["anchor"] = row[at]
        yield *row, state["anchor"]

    from pyspark.sql.types import LongType, StructField, StructType

    found = folded(events, ("instrument", "direction"), ("i",), lambda: {"anchor": None}, step, StructType([*events.schema.fields, StructField("anchor", LongType())]))
    size = F.count("*").over(Window.partitionBy("instrument", "direction", "anchor"))
    return found.withColumn("cluster_id", F.format_string("C%+d-%09d", "direction", "anchor")).withColumn("size", size).drop("anchor")


def non_overlapping(events: DataFrame, horizon: int, by=("instrument", "pattern", "direction")) -> DataFrame:
    """In order, each event that comes at least ``horizon`` bars after the last one kept; of events at one bar any may be kept."""
    return _spaced(events, horizon, by).filter("spaced").drop("spaced")


def _spaced(events: DataFrame, horizon: int, by) -> DataFrame:
    from pyspark.sql.types import BooleanType, StructField, StructType

    at = events.columns.index("i")

    def step(state, row):
        kept = row[at] - state["last"] >= horizon
        if kept:
            state["last"] = row[at]
        yield *row, kept

    return folded(events, tuple(by), ("i",), lambda: {"last": -(10**12)}, step, StructType([*events.schema.fields, StructField("spaced", BooleanType())]))


def _share_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """z of two shares; 0 where it can't be told."""
    pooled = (x1 + x2) / F.nullif(n1 + n2, F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0))))
    return F.when((n1 > 0) & (n2 > 0) & (error > 0), (x1 / n1 - x2 / n2) / error).otherwise(0.0)


class _Chains:
    """Greedy picks at least ``horizon`` bars apart, at once for every group, for all events but a group's, and for all events."""

    def __init__(self, horizon: int):
        self.horizon, self.number = horizon, {}
        self.last_own, self.last_rest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.own, self.rest = np.zeros((0, 4)), np.zeros((0, 2))
        self.last, self.all = -(10**12), [0, 0]

    def add(self, i: int, group: str, won: bool, r: float) -> None:
        k = self.number.setdefault(group, len(self.number))
        if k == len(self.last_own):
            # until now all events were other than this group's
            self.last_own, self.last_rest = np.append(self.last_own, -(10**12)), np.append(self.last_rest, self.last)
            self.own, self.rest = np.vstack([self.own, np.zeros(4)]), np.vstack([self.rest, self.all])
        if i - self.last_own[k] >= self.horizon:
            self.last_own[k] = i
            self.own[k] += (1, won, r, r * r)
        if i - self.last >= self.horizon:
            self.last = i
            self.all = [self.all[0] + 1, self.all[1] + won]
        free = i - self.last_rest >= self.horizon
        free[k] = False
        if free.any():
            self.last_rest[free] = i
            self.rest[free] += (1, won)


def _independent(rows: DataFrame, horizon: int) -> DataFrame:
    """(group, direction): picks that don't overlap, of the group and of all other groups of the direction, from one fold a series."""

    def step(state, row):
        state["chains"].add(row[2], row[3], row[4], row[5])
        return ()

    def finish(key, state):
        c = state["chains"]
        yield (*key, None, 0, 0, 0.0, 0.0, c.all[0], c.all[1])
        for group, k in c.number.items():
            yield (*key, group, int(c.own[k, 0]), int(c.own[k, 1]), float(c.own[k, 2]), float(c.own[k, 3]), int(c.rest[k, 0]), int(c.rest[k, 1]))

    out = "instrument string, direction long, group string, free long, free_wins long, free_sum double, free_squares double, rest_free long, rest_wins long"
    found = folded(rows.select("instrument", "direction", "i", "group", "won", "r"), ("instrument", "direction"), ("i",), lambda: {"chains": _Chains(horizon)}, step, out, finish)
    found = stored(found)
    # in a series without a group all events are other than its own
    every = found.filter("group is null").select("instrument", "direction", F.col("rest_free").alias("a"), F.col("rest_wins").alias("b")).join(found.filter("group is not null").select("direction", "group").distinct(), "direction")
    own = found.filter("group is not null")
    both = every.join(own, ["instrument", "direction", "group"], "left")
    sums = both.groupBy("group", "direction").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("free", "free_wins", "free_sum", "free_squares")), F.sum(F.coalesce("rest_free", "a")).alias("_m_free"), F.sum(F.coalesce("rest_wins", "b")).alias("_other_free_wins"))
    n, total = F.col("free"), F.col("free_sum")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("free_squares") - total * total / n) / (n - 1)))
    return sums.select("group", "direction", n.alias("n_independent"), F.col("free_wins").alias("_free_wins"), "_m_free", "_other_free_wins", (total / F.nullif(n, F.lit(0))).alias("_free_mean"), spread.alias("_free_sd"))


def base_rates(results: DataFrame, horizon: int, least: int = LEAST_N, by: tuple[str, ...] = (), leave_out: Column | None = None) -> DataFrame:
    """Per pattern (and further columns ``by``) and direction: how often and how far the end lies in favour, against all other groups of the direction.

    results are ``outcomes`` of ``clusters``; rows for which ``leave_out`` holds (those near a contract seam, say) don't count;
    of events at one bar any may be the one that doesn't overlap, since they have one outcome.  What holds for all other
    groups is what holds for the direction less the group: sums are differences, medians come from counts of ranks, and events
    that don't overlap from one fold that keeps a chain for every group.  Outcomes are written once; no row is copied.
    """
    names = ("pattern", *by)
    rows = results.filter((F.col("horizon") == horizon) & F.col("end_r").isNotNull())
    if leave_out is not None:
        rows = rows.filter(~F.coalesce(leave_out, F.lit(False)))
    rows = rows.withColumn("group", F.concat_ws("/", *names))
    rows = stored(rows.select(
        "instrument", "i", "direction", "group", *names, (~(F.col("atr") >= MIN_ATR)).alias("small"), F.concat_ws("/", "instrument", "cluster_id").alias("cluster"), (F.col("end_points") > 0).alias("won"),
        F.greatest(F.lit(-R_LIMIT), F.least(F.lit(R_LIMIT), "end_r")).alias("r"), (F.abs("end_r") > R_LIMIT).alias("clipped"), "mfe_r", "mae_r",
    ))
    dropped = rows.groupBy("group", "direction").agg(F.count_if("small").alias("n_dropped_atr"))
    rows = rows.filter("not small")
    own = rows.groupBy("group", "direction").agg(
        *(F.first(c).alias(c) for c in names), F.count("*").alias("n"), F.count_distinct("cluster").alias("n_clusters"), F.count_if("clipped").alias("n_clipped"), F.count_if("won").alias("_wins"), F.sum("r").alias("_sum"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"),
    )
    side = Window.partitionBy("direction")
    own = stored(own).withColumn("m", F.sum("n").over(side) - F.col("n")).withColumn("_other_wins", F.sum("_wins").over(side) - F.col("_wins"))
    own = own.withColumn("base_mean_r", F.coalesce((F.sum("_sum").over(side) - F.col("_sum")) / F.nullif("m", F.lit(0)), F.lit(0.0)))
    asks = [("median_r", "r", 0.5, False), ("_rest", "r", 0.5, True), ("mfe_r_median", "mfe_r", 0.5, False), ("mae_r_median", "mae_r", 0.5, False), ("mae_r_p90", "mae_r", 0.9, False)]
    middles = exact_quantiles(rows, "group", "direction", asks).withColumn("base_median_r", F.coalesce("_rest", F.lit(0.0))).drop("_rest")
    g = own.filter(F.col("n") >= least).join(_independent(rows, horizon), ["group", "direction"]).join(middles, ["group", "direction"]).join(dropped, ["group", "direction"])
    n, p, z = F.col("n"), F.col("_wins") / F.col("n"), 1.96
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    center = (p + z * z / (2 * n)) / (1 + z * z / n)
    t = lambda mean, sd, k: F.when((k >= 2) & (sd > 0), (mean - F.col("base_mean_r")) / (sd / F.sqrt(k))).otherwise(0.0)
    enough = (F.col("n_independent") >= LEAST_N) & (F.col("_m_free") >= LEAST_N)
    hints = F.array_compact(F.array(F.when(n < SOLID_N, "small_sample"), F.when(F.col("n_independent") < LEAST_N, "few_independent"), F.when(F.abs(F.col("mean_r") - F.col("median_r")) > 0.5, "heavy_tails"), F.when(F.col("n_dropped_atr") > 0.02 * (n + F.col("n_dropped_atr")), "many_dropped")))
    return g.select(
        *names, "direction", "n", "n_independent", "n_clusters", "n_dropped_atr", "n_clipped", p.alias("share"), F.greatest(F.lit(0.0), center - half).alias("share_low"), F.least(F.lit(1.0), center + half).alias("share_high"),
        (F.col("_other_wins") / F.nullif("m", F.lit(0))).alias("base_share"), (p - F.col("_other_wins") / F.nullif("m", F.lit(0))).alias("share_edge"),
        F.when(enough, _share_z(F.col("_free_wins"), F.col("n_independent"), F.col("_other_free_wins"), F.col("_m_free"))).otherwise(0.0).alias("share_z"), _share_z(F.col("_wins"), n, F.col("_other_wins"), F.col("m")).alias("share_z_overlapping"),
        "mean_r", "median_r", "sd_r", "base_mean_r", "base_median_r", (F.col("mean_r") - F.col("base_mean_r")).alias("edge_r"), (F.col("median_r") - F.col("base_median_r")).alias("median_edge_r"),
        "mfe_r_median", "mae_r_median", "mae_r_p90", t(F.col("_free_mean"), F.col("_free_sd"), F.col("n_independent")).alias("t"), t(F.col("mean_r"), F.col("sd_r"), n).alias("t_overlapping"), F.array_join(hints, ",").alias("hints"),
    )


def with_rate_p_values(rates: DataFrame) -> DataFrame:
    """Base rates with two-sided p of their z and t; the table has a row a pattern and direction."""

    def normal(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    def student(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_p_value(a, b - 1) if b >= 2 else 1.0 for a, b in zip(t, n, strict=True)])

    two_sided, of_t = F.pandas_udf(normal, "double"), F.pandas_udf(student, "double")
    return rates.select(
        "*", two_sided("share_z").alias("share_p"), two_sided("share_z_overlapping").alias("share_p_overlapping"),
        of_t("t", F.col("n_independent").cast("double")).alias("p"), of_t("t_overlapping", F.col("n").cast("double")).alias("p_overlapping"),
    )
