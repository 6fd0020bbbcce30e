"""What follows when a condition holds, against what follows at any bar: excursions in ATR, tests with and without overlap, and which of a target and a stop comes first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.blocks import Ahead, Bars, in_blocks
from barspark.functions.quantiles import exact_quantiles
from barspark.functions.stored import stored
from barspark.operators.events import non_overlapping
from barspark.operators.indicators import atr

#: Targets and stops in ATR, and what stands for an ATR that isn't known; fixed.
TARGETS = (1.0, 1.5, 2.0, 3.0)
STOPS = (1.0, 1.5, 2.0)
UNKNOWN_ATR = 5.0


def excursions(bars: DataFrame, horizon: int = 20) -> DataFrame:
    """(instrument, i, direction, mfe_r, mae_r, final_r, mfe_at, mae_at) of an entry at the next open, in both directions, in ATR of the bar; bars whose window isn't followed by another bar are left out.

    Where the price never goes in favour (or against) the excursion is 0, at bar 0.
    """

    def both(block: Bars) -> dict:
        at = np.arange(block.own.start, block.own.stop)
        at = at[at + horizon + 1 < len(block)]
        entry, unit = block["open"][at + 1], block["atr"][at]
        unit = np.where(np.isfinite(unit) & (unit > 0), unit, UNKNOWN_ATR)
        tops, bottoms = Ahead(block["high"]), Ahead(block["low"], low=True)
        top, bottom = tops.extreme(at + 1, at + 1 + horizon), bottoms.extreme(at + 1, at + 1 + horizon)
        up, down = np.maximum(0.0, top - entry), np.maximum(0.0, entry - bottom)
        up_at, down_at = np.where(up > 0, tops.first(at + 1, top) - at, 0), np.where(down > 0, bottoms.first(at + 1, bottom) - at, 0)
        end = block["close"][at + horizon] - entry
        pair = lambda x, y: np.concatenate([x, y])
        side = pair(np.ones(len(at), np.int64), -np.ones(len(at), np.int64))
        return {"i": pair(block.i[at], block.i[at]), "direction": side, "mfe_r": pair(up / unit, down / unit), "mae_r": pair(down / unit, up / unit), "final_r": pair(end / unit, -end / unit), "mfe_at": pair(up_at, down_at), "mae_at": pair(down_at, up_at)}

    out = "instrument string, i long, direction long, mfe_r double, mae_r double, final_r double, mfe_at long, mae_at long"
    return in_blocks(atr(bars), ("open", "high", "low", "close", "atr"), 0, horizon + 1, both, out)


def occurrences(bars: DataFrame, named: dict[str, tuple[Column, int]], horizon: int = 20) -> tuple[DataFrame, DataFrame]:
    """Excursions of the bars at which each named condition (a column and a direction) holds, and those of all bars."""
    each = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("condition"), F.lit(d).cast("long").alias("direction"))) for n, (c, d) in named.items())))
    hits = bars.select("instrument", "i", F.explode(each).alias("c")).select("instrument", "i", "c.*")
    every = stored(excursions(bars, horizon))
    return stored(hits.join(every, ["instrument", "i", "direction"])), every


def conditional_report(hits: DataFrame, every: DataFrame, horizon: int = 20) -> DataFrame:
    """Per condition: how many, mean and median end, median excursions, the edge over all bars of the direction, and t of the ends against their mean, of those that don't overlap and (too large) of all."""
    base = every.groupBy("direction").agg(F.count("*").alias("n_base"), F.avg("final_r").alias("base_mean_r"))
    apart = non_overlapping(hits.select("instrument", "condition", "direction", "i", "final_r"), horizon, ("instrument", "condition"))
    free = apart.groupBy("condition", "direction").agg(F.count("*").alias("n_independent"), F.avg("final_r").alias("_m"), F.stddev_samp("final_r").alias("_s"))
    all_ = hits.groupBy("condition", "direction").agg(F.count("*").alias("n"), F.avg("final_r").alias("mean_r"), F.stddev_samp("final_r").alias("_sd"))
    asks = [("median_r", "final_r", 0.5, False), ("mfe_r_median", "mfe_r", 0.5, False), ("mae_r_median", "mae_r", 0.5, False)]
    middles = exact_quantiles(hits, "condition", "direction", asks)
    out = all_.join(free, ["condition", "direction"]).join(middles, ["condition", "direction"]).join(F.broadcast(base), "direction")  # two rows
    t = lambda m, s, n: F.when((n >= 2) & (s > 0), (m - F.col("base_mean_r")) / (s / F.sqrt(n))).otherwise(0.0)
    return out.select(
        "condition", "direction", "n", "n_base", "n_independent", "mean_r", "median_r", "mfe_r_median", "mae_r_median", "base_mean_r", (F.col("mean_r") - F.col("base_mean_r")).alias("edge_r"),
        t(F.col("_m"), F.col("_s"), F.col("n_independent")).alias("t"), t(F.col("mean_r"), F.col("_sd"), F.col("n")).alias("t_overlapping"),
    )


def conditional_grid(hits: DataFrame, targets=TARGETS, stops=STOPS) -> DataFrame:
    """Per condition, target and stop: what the largest excursions reach; where both are reached the one whose extreme comes first, the stop if at once."""
    cells = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(s).alias("stop")) for t in targets for s in stops))
    rows = hits.withColumn("g", F.explode(cells)).select("condition", "direction", "g.*", "mfe_r", "mae_r", "mfe_at", "mae_at")
    up, down = F.col("mfe_r") >= F.col("target"), F.col("mae_r") >= F.col("stop")
    lost = down & (~up | (F.col("mae_at") <= F.col("mfe_at")))
    out = rows.groupBy("condition", "direction", "target", "stop").agg(F.count("*").alias("n"), F.count_if(up & ~lost).alias("hits"), F.count_if(lost).alias("losses"), F.count_if(~up & ~down).alias("neither"))
    return out.withColumn("win_rate", F.coalesce(F.col("hits") / F.nullif(F.col("hits") + F.col("losses"), F.lit(0)), F.lit(0.0)))
