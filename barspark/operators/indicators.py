"""Indicators of a bar series as columns: each function takes bars and returns them with columns added."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.blocks import SIZE, Bars, ranks_in_windows, with_block_columns
from barspark.functions.rolling import between, ewm, filled, lagged, over_last
from barspark.functions.sessions import session_date
from barspark.sources.bars import series


def ema(bars: DataFrame, n: int, column: str = "close", out: str | None = None) -> DataFrame:
    return ewm(bars, column, 2 / (n + 1), out or f"ema{n}", n)


def wilder(bars: DataFrame, column: str, n: int, out: str) -> DataFrame:
    return ewm(bars, column, 1 / n, out, n)


def true_range(bars: DataFrame) -> DataFrame:
    pc = lagged("close")
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """bars with tr and atr; bars that have both keep them (of 14 bars)."""
    if n == 14 and {"tr", "atr"} <= set(bars.columns):
        return bars
    return wilder(true_range(bars), "tr", n, "atr")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """100 where nothing falls, 0 where nothing rises (flat included), null before n changes."""
    d = F.col("close") - lagged("close")
    rows = bars.withColumn("_up", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))).withColumn("_down", F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))))
    rows = wilder(wilder(rows, "_up", n, "_gain"), "_down", n, "_loss")
    value = F.when(F.col("_gain") == 0, 0.0).when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    return rows.withColumn("rsi", F.when(F.col("_loss").isNotNull(), value)).drop("_up", "_down", "_gain", "_loss")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    rows = ema(ema(bars, fast, out="_fast"), slow, out="_slow").withColumn("macd", F.col("_fast") - F.col("_slow"))
    rows = ewm(rows, "macd", 2 / (signal + 1), "macd_signal", signal)
    return rows.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def stochastic(bars: DataFrame, n: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    top, bottom = over_last(F.max, "high", n), over_last(F.min, "low", n)
    rows = bars.withColumn("_raw", 100 * (F.col("close") - bottom) / F.nullif(top - bottom, F.lit(0.0)))
    rows = rows.withColumn("stoch_k", over_last(F.avg, "_raw", smooth_k))
    return rows.withColumn("stoch_d", over_last(F.avg, "stoch_k", smooth_d)).drop("_raw")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    up, down = F.col("high") - lagged("high"), lagged("low") - F.col("low")
    rows = bars.withColumn("_u", F.coalesce(up, F.lit(0.0))).withColumn("_d", F.coalesce(down, F.lit(0.0)))
    rows = rows.withColumn("_p", F.when((F.col("_u") > F.col("_d")) & (F.col("_u") > 0), F.col("_u")).otherwise(0.0))
    rows = rows.withColumn("_m", F.when((F.col("_d") > F.col("_u")) & (F.col("_d") > 0), F.col("_d")).otherwise(0.0))
    rows = wilder(wilder(atr(rows, n), "_p", n, "_sp"), "_m", n, "_sm")
    rows = rows.withColumn("plus_di", 100 * F.col("_sp") / F.nullif("atr", F.lit(0.0))).withColumn("minus_di", 100 * F.col("_sm") / F.nullif("atr", F.lit(0.0)))
    both = F.nullif(F.col("plus_di") + F.col("minus_di"), F.lit(0.0))
    rows = rows.withColumn("_dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / both)
    return wilder(rows, "_dx", n, "adx").drop("_u", "_d", "_p", "_m", "_sp", "_sm", "_dx")


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0, keltner: float = 1.5) -> DataFrame:
    rows = atr(bars, n).withColumnRenamed("atr", "_atr")
    mid, dev = over_last(F.avg, "close", n), over_last(F.stddev_pop, "close", n)
    rows = ema(rows, n, out="_kmid").withColumn("bb_mid", mid).withColumn("bb_upper", mid + width * dev).withColumn("bb_lower", mid - width * dev)
    inside = (F.col("bb_upper") < F.col("_kmid") + keltner * F.col("_atr")) & (F.col("bb_lower") > F.col("_kmid") - keltner * F.col("_atr"))
    return rows.withColumn("squeeze", F.coalesce(inside, F.lit(False))).drop("_atr", "_kmid", "tr")


def session_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted price since the session began; the typical price while nothing was traded."""
    w = Window.partitionBy("instrument", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = bars.withColumn("session", session_date(F.col("ts")))
    return rows.withColumn("vwap", F.coalesce(F.sum(tp * F.col("volume")).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0)), tp))


def previous_session(bars: DataFrame) -> DataFrame:
    """High, low and close of the session before, by the sessions that exist."""
    rows = bars.withColumn("session", session_date(F.col("ts")))
    so_far = Window.partitionBy("instrument", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_day", F.struct(F.max("high").over(so_far).alias("high"), F.min("low").over(so_far).alias("low"), "close"))
    # a session's last bar has its whole values; the bars after it see them
    ended = F.when(F.lead("session").over(series()) != F.col("session"), F.col("_day"))
    rows = rows.withColumn("_before", F.last(ended, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1)))
    return rows.select("*", *(F.col(f"_before.{c}").alias(f"prev_{c}") for c in ("high", "low", "close"))).drop("_day", "_before")


def ema_stack(bars: DataFrame, periods=(9, 21, 50, 200)) -> DataFrame:
    rows = bars
    for n in periods:
        rows = ema(rows, n)
    cols = [F.col(f"ema{n}") for n in periods]
    full = lambda op: F.coalesce(F.expr(" and ".join(f"ema{a} {op} ema{b}" for a, b in zip(periods, periods[1:], strict=False))), F.lit(False))
    state = F.when(full(">"), "bullish").when(full("<"), "bearish").when(cols[-1].isNotNull(), "mixed")
    return rows.withColumn("ema_stack", state)


def flag_signals(bars: DataFrame, impulse: int = 20, impulse_atr: float = 2.5, consolidation: int = 10, max_range_atr: float = 2.4, buffer_atr: float = 0.1) -> DataFrame:
    """A strong move, then a narrow range: its bounds and width, the move, whether it holds, and closes beyond it by a buffer.

    The range is that of the bars before the current one, the ATR the last one before it.  The direction is the
    move's while the range is narrow; a downward move overrides an upward one.
    """
    rows = atr(bars).withColumn("_ref", lagged("atr"))
    rows = rows.withColumn("flag_top", between(F.max, "high", -consolidation, -1)).withColumn("flag_bottom", between(F.min, "low", -consolidation, -1))
    rows = rows.withColumn("flag_range", F.col("flag_top") - F.col("flag_bottom")).withColumn("flag_impulse", lagged("close", consolidation) - lagged("close", consolidation + impulse))
    narrow, strong = F.col("flag_range") <= max_range_atr * F.col("_ref"), impulse_atr * F.col("_ref")
    rows = rows.withColumn("_up", F.coalesce((F.col("flag_impulse") >= strong) & narrow, F.lit(False))).withColumn("_down", F.coalesce((F.col("flag_impulse") <= -strong) & narrow, F.lit(False)))
    rows = rows.withColumn("flag_up", F.col("_up") & (F.col("close") > F.col("flag_top") + buffer_atr * F.col("_ref"))).withColumn("flag_down", F.col("_down") & (F.col("close") < F.col("flag_bottom") - buffer_atr * F.col("_ref")))
    rows = rows.withColumn("flag_direction", F.when(F.col("_down"), -1).when(F.col("_up"), 1).otherwise(0).cast("long"))
    return rows.withColumn("flag_forming", (F.col("_up") | F.col("_down")) & ~F.col("flag_up") & ~F.col("flag_down")).drop("_ref", "_up", "_down")


def relative_volume(bars: DataFrame, sessions: int = 60, at_least: int = 15) -> DataFrame:
    """Volume over the median of the last bars at the same time of day (UTC), the current one included.

    Bars are dealt by time of day, so that a group has a bar a day.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = bars.columns
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema)
    schema = bars.sparkSession.createDataFrame([], f"{plain}, rel_volume double").schema
    arrow = to_arrow_schema(schema)

    def of_time(key, table):
        rows = table.take(pa.array(np.argsort(table.column("ts").to_numpy(), kind="stable")))
        volume = rows.column("volume").to_numpy().astype(np.float64)
        padded = np.r_[np.full(sessions - 1, np.nan), volume]
        usual = np.full(len(volume), np.nan)
        for first in range(0, len(volume), 4096):
            part = np.sort(np.lib.stride_tricks.sliding_window_view(padded, sessions)[first : first + 4096], axis=1)  # nan last
            n = np.count_nonzero(~np.isnan(part), axis=1)
            k, there = np.arange(len(part)), n >= at_least
            lower, upper = part[k, np.maximum(n - 1, 0) // 2], part[k, np.minimum(n // 2, sessions - 1)]
            usual[first : first + 4096] = np.where(there, (lower + upper) / 2, np.nan)
        share = np.divide(volume, usual, out=np.full(len(volume), np.nan), where=usual != 0)
        return pa.table([*(rows.column(c).cast(arrow.field(c).type) for c in names), pa.array(share, pa.float64(), from_pandas=True)], schema=arrow)

    timed = bars.withColumn("_tod", (F.hour("ts") * 60 + F.minute("ts")).cast("long"))
    return timed.groupBy("instrument", "_tod").applyInArrow(of_time, schema)


def relative_volume_trailing(bars: DataFrame, n: int = 60, at_least: int = 15) -> DataFrame:
    """Volume over the median of the last n bars, the current one included."""
    w = series().rowsBetween(-n + 1, 0)
    median = F.when(F.count("volume").over(w) >= at_least, F.percentile("volume", 0.5).over(w))
    return bars.withColumn("trailing_volume", F.col("volume") / F.nullif(median, F.lit(0.0)))


def extended(bars: DataFrame) -> DataFrame:
    """bars with MACD, stochastic, ADX, Bollinger bands and squeeze, and the EMA stack, by windows over one scan."""
    return ema_stack(bollinger(adx(stochastic(macd(bars)))))


def rolling_ranks(bars: DataFrame, columns: dict[str, str], n: int) -> DataFrame:
    """bars with, for each column, the share of its last n values at or under the current one, ties counting half; null under max(20, n / 3) values.

    Blocks of n bars at least see the n bars before them; ranks of all windows of a block come from a few passes over it.
    """

    def ranks(block: Bars) -> dict[str, np.ndarray]:
        out = {}
        for column, name in columns.items():
            values = block[column].astype(np.float64)
            known = ~np.isnan(values)
            before = np.r_[0, np.cumsum(known)]
            own = np.arange(block.own.start, block.own.stop)
            end, start = before[own + 1], before[np.maximum(own + 1 - n, 0)]
            rank, ask = np.full(len(own), np.nan), known[own] & (end - start >= max(20, n // 3))
            if ask.any():
                less, equal = ranks_in_windows(values[known], start[ask], end[ask], end[ask] - 1)
                rank[ask] = (less + 0.5 * equal + 0.5) / (end - start)[ask]
            out[name] = rank
        return out

    return with_block_columns(bars, tuple(columns), n - 1, ranks, ", ".join(f"{name} double" for name in columns.values()), max(SIZE, n))


def rolling_rank(bars: DataFrame, column: str, n: int, out: str) -> DataFrame:
    return rolling_ranks(bars, {column: out}, n)


def tercile(rank) -> "F.Column":
    return F.when(rank <= 1 / 3, "low").when(rank <= 2 / 3, "mid").when(rank.isNotNull(), "high")


def regime(bars: DataFrame, n: int = 60 * 23) -> DataFrame:
    """Volatility, structure and liquidity terciles over the last n bars (60 sessions of hours), and their joint label where all three are known."""
    axes = {"atr": "vola", "adx": "structure", "rel_volume": "liquidity"}
    rows = rolling_ranks(relative_volume(adx(bars)), {column: f"{out}_rank" for column, out in axes.items()}, n)
    for out in axes.values():
        rows = rows.withColumn(out, tercile(F.col(f"{out}_rank")))
    return rows.withColumn("regime", F.when(F.col("vola").isNotNull() & F.col("structure").isNotNull() & F.col("liquidity").isNotNull(), F.concat_ws("|", "vola", "structure", "liquidity")))


def range_compression(bars: DataFrame, n: int = 20, history: int = 60, most: float = 0.6) -> DataFrame:
    """The current range over n bars against the median of earlier ranges that don't overlap it."""
    rows = bars.withColumn("range_now", over_last(F.max, "high", n) - over_last(F.min, "low", n))
    w = series().rowsBetween(-history - n + 1, -n)
    rows = rows.withColumn("range_usual", F.when(F.count("range_now").over(w) == history, F.percentile("range_now", 0.5).over(w)))
    return rows.withColumn("compressed", F.coalesce(F.col("range_now") / F.nullif("range_usual", F.lit(0.0)) <= most, F.lit(False)))
