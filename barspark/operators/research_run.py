"""A research run from entries to verdicts: what follows each entry, net of costs, in and out of sample, tested, and kept in the register."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.blocks import Ahead, Bars, at_events
from barspark.operators.costs import PROFILES, CostProfile, net_of_costs
from barspark.operators.research import data_hash
from barspark.sources.runs import register

LEAST_TRADES = 30
IN_SAMPLE = 0.7
#: Beyond this a normal variable lies in one of twenty cases.
Z = 1.959963984540054


def measured(entries: DataFrame, bars: DataFrame, horizon: int = 20) -> DataFrame:
    """Each entry (instrument, i, strategy, direction, stop, target) followed from the next open to its stop or target, or to the close after ``horizon`` bars: exit_i, how it ended and its points.

    Entries are measured each for itself, none waits for another; stop and target may be missing; a bar that touches both
    is the stop's; entries without a complete window are left out.
    """
    rows = entries.select("instrument", "i", "strategy", "direction", F.col("stop").cast("double").alias("stop"), F.col("target").cast("double").alias("target"))

    def follow(block: Bars, given: pa.Table, at: np.ndarray) -> dict:
        whole = np.flatnonzero(at + horizon < len(block))
        given, at = given.take(pa.array(whole)), at[whole]
        side, stop, target = given.column("direction").to_numpy(), given.column("stop").to_numpy(), given.column("target").to_numpy()
        none = horizon + 1
        lost, won = np.full(len(at), none), np.full(len(at), none)
        tops, bottoms = Ahead(block["high"]), Ahead(block["low"], low=True)
        for d, against, in_favour in ((1, bottoms, tops), (-1, tops, bottoms)):
            for price, ahead, out in ((stop, against, lost), (target, in_favour, won)):
                own = np.flatnonzero((side == d) & np.isfinite(price))
                out[own] = np.minimum(ahead.first(at[own] + 1, price[own]) - at[own], none)
        entry = block["open"][at + 1]
        stopped, reached = (lost <= horizon) & (lost <= won), (won <= horizon) & (won < lost)
        steps = np.where(stopped, lost, np.where(reached, won, horizon))
        leave = np.where(stopped, stop, np.where(reached, target, block["close"][at + horizon]))
        how = np.where(stopped, "stop", np.where(reached, "target", "time"))
        return {"i": block.i[at], "strategy": given.column("strategy"), "direction": side, "entry": entry, "exit_i": block.i[at] + steps, "exit": leave, "ended": how.astype(object), "points": side * (leave - entry)}

    out = "instrument string, i long, strategy string, direction long, entry double, exit_i long, exit double, ended string, points double"
    return at_events(rows, bars, ("open", "high", "low", "close"), 0, horizon + 1, follow, out)


def verdicts(trades: DataFrame, bars: DataFrame, profile: CostProfile = PROFILES[1], share: float = IN_SAMPLE, least: int = LEAST_TRADES) -> DataFrame:
    """Per strategy: trades and net results of the first part of every series and of the rest, t of the first part's trades against nought, and the verdict on them alone.

    undecided under ``least`` trades or without any spread, candidate where they earn and t is beyond ``Z``, else rejected.  A
    candidate is not confirmed: nothing is corrected for the number of strategies.
    """
    sizes = bars.groupBy("instrument").agg(F.floor((F.max("i") + 1) * share).alias("cut"))
    rows = net_of_costs(trades, (profile,)).join(sizes, "instrument").withColumn("inside", F.col("i") < F.col("cut"))
    inside, outside = F.when(F.col("inside"), F.col("net")), F.when(~F.col("inside"), F.col("net"))
    out = rows.groupBy("strategy").agg(
        F.count(inside).alias("n_train"), F.count(outside).alias("n_oos"), F.coalesce(F.sum(inside), F.lit(0.0)).alias("net_train"), F.coalesce(F.sum(outside), F.lit(0.0)).alias("net_oos"), F.avg(inside).alias("_mean"), F.stddev_samp(inside).alias("_sd"),
        F.avg((inside > 0).cast("double")).alias("won_train"), F.avg((outside > 0).cast("double")).alias("won_oos"),
    )
    t = F.when((F.col("n_train") >= least) & (F.col("_sd") > 0), F.col("_mean") / (F.col("_sd") / F.sqrt("n_train")))
    out = out.withColumn("t", t)
    verdict = F.when(F.isnull("t"), "undecided").when((F.abs("t") > Z) & (F.col("net_train") > 0), "candidate").otherwise("rejected")
    return out.withColumn("verdict", verdict).drop("_mean", "_sd")


def research_run(entries: DataFrame, bars: DataFrame, root: str, code: str, horizon: int = 20, profile: CostProfile = PROFILES[1]) -> DataFrame:
    """Verdicts of all strategies, each appended to the register at ``root`` with its data's hash, its numbers and the version of the code; run again on the same data, nothing is added."""
    spark = bars.sparkSession
    line = F.concat_ws("|", "instrument", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), *("open", "high", "low", "close", "volume"))
    known = data_hash(bars, F.to_date("ts"), line).first()
    found = verdicts(measured(entries, bars, horizon), bars, profile).orderBy("strategy").collect()  # a row a strategy
    rows = []
    for r in found:
        p = None if r["t"] is None else math.erfc(abs(r["t"]) / math.sqrt(2))
        entry = {
            "title": f"{r['strategy']} after {horizon} bars at most", "verdict": r["verdict"], "data": known["hash"], "code": code, "profile": profile.name, "assumed_costs": profile.assumed, "split": IN_SAMPLE,
            "train": {"n": r["n_train"], "net": round(r["net_train"], 6)}, "oos": {"n": r["n_oos"], "net": round(r["net_oos"], 6)}, "t": None if r["t"] is None else round(r["t"], 6), "p": None if p is None else round(p, 9),
        }
        rows.append((register(spark, root, entry), r["strategy"], r["verdict"], r["n_train"], r["n_oos"], r["t"], p))
    return spark.createDataFrame(rows, "id string, strategy string, verdict string, n_train long, n_oos long, t double, p double")
