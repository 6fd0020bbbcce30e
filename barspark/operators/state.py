"""The whole state of a market at a moment: six timeframes from one pass over minute bars, levels, pools of equal highs and lows, sweeps, as a nested document and as a flat vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.sessions import RTH, local, minute_of_day, session_date, to_utc
from barspark.functions.stored import stored
from barspark.operators.indicators import adx, rsi, session_vwap
from barspark.operators.levels import level_columns, levels_long
from barspark.operators.points import equal_levels, open_gaps
from barspark.operators.structure import displacements, liquidity_sweeps, structure_breaks, trend, with_last_swings
from barspark.sources.bars import numbered

FRAMES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}
#: Levels with their distance to the price, and those whose sweeps count; fixed.
DISTANCES = ("pdh", "pdl", "onh", "onl", "ib_high", "ib_low")
SWEPT = ("pdh", "pdl", "onh", "onl")
#: ATR of five-minute bars under and over which volatility is low and high; bars for which something is recent; minutes for which a sweep is.
LOW_ATR, HIGH_ATR = 3.0, 10.0
RECENT_BARS = 3
RECENT_MINUTES = 60
LEAST_BARS = 3


def rolled(bars: DataFrame) -> DataFrame:
    """Bars of all timeframes from minute bars in one aggregation; a series is named ``instrument|timeframe``.

    Minutes to an hour follow the clock, four hours the local one from 18:00, a day is a session; labels are ends.
    """
    before = F.col("ts") - F.expr("interval 1 microsecond")

    def ends(at: Column, minutes: int, origin: str) -> Column:
        zero = F.lit(origin).cast("timestamp_ntz")
        return F.timestamp_add("MINUTE", (F.floor(F.timestamp_diff("MINUTE", zero, at) / minutes) + 1) * minutes, zero)

    each = [F.struct(F.lit(name).alias("frame"), ends(before, m, "1970-01-01").alias("ts")) for name, m in FRAMES.items() if m <= 60]
    each.append(F.struct(F.lit("4h").alias("frame"), to_utc(ends(local(before), 240, "1970-01-01 02:00:00")).alias("ts")))
    each.append(F.struct(F.lit("1d").alias("frame"), to_utc(session_date(before).cast("timestamp_ntz") + F.expr("interval 17 hours")).alias("ts")))
    rows = bars.select("instrument", "open", "high", "low", "close", "volume", F.col("ts").alias("at"), F.explode(F.array(*each)).alias("e"))
    rows = rows.groupBy(F.concat_ws("|", "instrument", "e.frame").alias("instrument"), F.col("e.ts").alias("ts"))
    return rows.agg(F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.sum("volume").alias("volume"))


def frame_states(rows: DataFrame) -> DataFrame:
    """(instrument, frame, s) of numbered series: price, indicators, structure, open gaps and whether a displacement or a break is recent."""
    wide = trend(session_vwap(adx(rsi(rows)))).withColumnRenamed("trend", "direction")
    wide = with_last_swings(wide)
    row = F.struct(
        "ts", (F.col("i") + 1).alias("bars"), "close", "atr", "rsi", "adx", "direction", "basis", F.col("trend").alias("structure"), F.col("above").alias("above_sma50"), (F.col("close") > F.col("vwap")).alias("above_vwap"),
        F.col("high_price").alias("swing_high"), F.col("low_price").alias("swing_low"),
    )
    last = wide.groupBy("instrument").agg(F.max_by(row, "i").alias("r")).filter(F.col("r.bars") >= LEAST_BARS)
    gaps = open_gaps(rows).filter("mitigated_i is null").groupBy("instrument").agg(F.count("*").alias("gaps"))
    moved = displacements(rows).groupBy("instrument").agg(F.max("i").alias("moved"))
    broke = structure_breaks(rows).groupBy("instrument").agg(F.max("i").alias("broke"))
    for x in (gaps, moved, broke):
        last = last.join(x, "instrument", "left")
    recent = lambda c: F.coalesce(F.col("r.bars") - 1 - F.col(c) <= RECENT_BARS, F.lit(False)).alias(c)
    name = F.split("instrument", r"\|")
    return last.select(name[0].alias("instrument"), name[1].alias("frame"), F.struct("r.*", F.coalesce("gaps", F.lit(0)).alias("open_gaps"), recent("moved"), recent("broke")).alias("s"))


def market_state(bars: DataFrame, ticks: DataFrame, at: Column) -> DataFrame:
    """(instrument, at, price, session, volatility, liquidity, frames) from minute bars and ticks up to a moment; nothing later is seen.

    ``frames`` maps a timeframe to its state; one with under three bars is missing.
    """
    rows = stored(numbered(rolled(bars.filter(F.col("ts") <= at))))
    frames = frame_states(rows).groupBy("instrument").agg(F.map_from_entries(F.collect_list(F.struct("frame", "s"))).alias("frames"))  # six at most
    five = rows.filter(F.col("instrument").endswith("|5m"))
    seen = ticks.filter(F.col("ts") <= at).withColumn("instrument", F.concat("instrument", F.lit("|5m")))
    known = level_columns(five, seen)
    opening = [f"{n}_{side}" for n in ("or5", "or15") for side in ("high", "low")]
    levels = known.groupBy("instrument").agg(F.max_by(F.struct("atr", *DISTANCES, *opening), "i").alias("l"))
    price = rows.filter(F.col("instrument").endswith("|1m")).groupBy(F.split("instrument", r"\|")[0].alias("instrument")).agg(F.max_by("close", "i").alias("price"))

    pools = equal_levels(five, k=2, lookback=None).filter("not swept").groupBy("instrument").agg(
        *(F.count_if(F.col("kind") == k).alias(f"equal_{k}s") for k in ("high", "low")), F.array_sort(F.collect_list(F.struct("kind", "level"))).alias("open_levels")
    )  # a few a series
    pierced = liquidity_sweeps(levels_long(five, seen).filter(F.col("name").isin(*SWEPT)), five).join(five.select("instrument", "i", "ts"), ["instrument", "i"])
    fresh = pierced.filter(F.timestamp_diff("MICROSECOND", F.col("ts"), at) <= RECENT_MINUTES * 60_000_000)
    swept = fresh.groupBy("instrument").agg(F.max(F.col("direction") == -1).alias("sell"), F.max(F.col("direction") == 1).alias("buy"))
    context = levels.join(pools, "instrument", "left").join(swept, "instrument", "left").withColumn("instrument", F.split("instrument", r"\|")[0])

    out = price.join(frames, "instrument").join(context, "instrument", "left")
    minute = minute_of_day(local(at))
    p, unit = F.col("price"), F.when(F.col("l.atr") > 0, F.col("l.atr"))

    def beyond(name: str) -> Column:
        return F.when(p > F.col(f"l.{name}_high"), "up").when(p < F.col(f"l.{name}_low"), "down").alias(f"{name}_break")

    def nearest(kind: str) -> Column:
        away = F.transform(F.filter("open_levels", lambda x: x["kind"] == kind), lambda x: F.struct(F.abs(x["level"] - p).alias("d"), (x["level"] - p).alias("v")))
        return F.array_min(away)["v"].alias(f"nearest_equal_{kind}")

    session = F.struct(session_date(at).alias("day"), (minute >= RTH[0]).__and__(minute < RTH[1]).alias("rth"), F.pmod(minute - 1080, F.lit(1440)).alias("minutes"), F.col("l.ib_high").isNotNull().alias("ib_complete"), beyond("or5"), beyond("or15"))
    five_state = F.col("frames")["5m"]
    volatility = F.struct(five_state["atr"].alias("atr_5m"), F.col("frames")["1h"]["atr"].alias("atr_1h"), F.when(five_state["atr"] < LOW_ATR, "low").when(five_state["atr"] > HIGH_ATR, "high").otherwise("normal").alias("regime"), F.coalesce(five_state["moved"], F.lit(False)).alias("expanding"))
    liquidity = F.struct(
        *((F.col(f"l.{n}") - p).alias(n) for n in DISTANCES), *(((F.col(f"l.{n}") - p) / unit).alias(f"{n}_atr") for n in DISTANCES),
        *(F.coalesce(f"equal_{k}s", F.lit(0)).alias(f"equal_{k}s") for k in ("high", "low")), nearest("high"), nearest("low"), F.coalesce("sell", F.lit(False)).alias("swept_high"), F.coalesce("buy", F.lit(False)).alias("swept_low"),
    )
    return out.select("instrument", at.alias("at"), "price", session.alias("session"), volatility.alias("volatility"), liquidity.alias("liquidity"), "frames")


def feature_vector(states: DataFrame) -> DataFrame:
    """(instrument, name, value): the numbers of a state, truth as 1, what isn't known as 0 and an unknown RSI as 50; a missing timeframe has no names."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    sign = lambda c: F.when(c == "up", 1.0).when(c == "down", -1.0).otherwise(0.0)
    s, v, q = F.col("session"), F.col("volatility"), F.col("liquidity")
    plain = {"price": number(F.col("price")), "is_rth": flag(s["rth"]), "minutes_into_session": number(s["minutes"]), "ib_complete": flag(s["ib_complete"]), "or5_break": sign(s["or5_break"]), "or15_break": sign(s["or15_break"])}
    plain |= {"vola_high": flag(v["regime"] == "high"), "vola_low": flag(v["regime"] == "low"), "expanding": flag(v["expanding"])}
    plain |= {n: number(q[n]) for d in DISTANCES for n in (d, f"{d}_atr")} | {n: number(q[n]) for n in ("equal_highs", "equal_lows", "nearest_equal_high", "nearest_equal_low")} | {n: flag(q[n]) for n in ("swept_high", "swept_low")}
    entries = [F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in plain.items()]
    rows = states.select("instrument", F.explode(F.array(*entries)).alias("e")).select("instrument", "e.*")
    frames = states.select("instrument", F.explode("frames").alias("frame", "f"))
    f = F.col("f")
    own = {"uptrend": flag(f["structure"] == 1), "downtrend": flag(f["structure"] == -1), "above_sma50": flag(f["above_sma50"]), "above_vwap": flag(f["above_vwap"]), "gaps": number(f["open_gaps"]), "displacement": flag(f["moved"]), "break": flag(f["broke"])}
    own |= {"rsi": F.coalesce(f["rsi"], F.lit(50.0)), "adx": number(f["adx"])}
    each = [F.struct(F.concat("frame", F.lit(f"_{n}")).alias("name"), c.alias("value")) for n, c in own.items()]
    return rows.unionByName(frames.select("instrument", F.explode(F.array(*each)).alias("e")).select("instrument", "e.*"))
