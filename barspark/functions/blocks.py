"""Work on a series in blocks of rows with an overlap, so that one long series keeps many tasks busy.

A rule that looks a bounded number of bars back and ahead needs no whole series: each block of ``size`` bars gets the bars
before and after it that the rule may look at, and gives results for its own bars only.  A block is a bounded group,
whatever the length of a series; inside it rules are numpy operations over all of its bars or events at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bars of a block; two overlaps of some hundred bars add a few hundredths to it.
SIZE = 8192


class Bars:
    """A block's columns as arrays in order of ``i`` (nulls are nan), and where its own bars stand."""

    def __init__(self, table: pa.Table, columns: tuple[str, ...], block: int, size: int):
        i = table.column("i").to_numpy()
        order = np.argsort(i, kind="stable")
        self.i = i[order]
        self.columns = {c: table.column(c).to_numpy()[order] for c in columns}
        self.own = slice(*np.searchsorted(self.i, [block * size, (block + 1) * size]))
        self.first = int(self.i[0]) if len(self.i) else 0

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]

    def __len__(self) -> int:
        return len(self.i)


def _spread(bars: DataFrame, columns: tuple[str, ...], before: int, after: int, size: int) -> DataFrame:
    """Each bar once for every block that may look at it; a series' numbers have no gaps."""
    first, last = F.floor(F.greatest(F.col("i") - after, F.lit(0)) / size), F.floor((F.col("i") + before) / size)
    return bars.select("instrument", "i", *columns, F.explode(F.sequence(first, last)).alias("block"))


def _built(result: dict[str, np.ndarray], instrument, schema: pa.Schema) -> pa.Table:
    n = len(next(iter(result.values())))
    arrays = []
    for f in schema:
        if f.name == "instrument" and "instrument" not in result:
            arrays.append(pa.array([instrument] * n, f.type))
        else:
            x = result[f.name]
            arrays.append(x.cast(f.type) if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x, f.type, from_pandas=True))
    return pa.table(arrays, schema=schema)


def _schemas(bars: DataFrame, out: str) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = bars.sparkSession.createDataFrame([], out).schema
    return schema, to_arrow_schema(schema)


def in_blocks(bars: DataFrame, columns: tuple[str, ...], before: int, after: int, run: Callable[[Bars], dict[str, np.ndarray]], out: str, size: int = SIZE) -> DataFrame:
    """What ``run`` gives for the own bars of each block; ``instrument`` is added."""
    schema, arrow = _schemas(bars, out)

    def each(key, table):
        return _built(run(Bars(table, columns, key[1].as_py(), size)), key[0].as_py(), arrow)

    return _spread(bars, columns, before, after, size).groupBy("instrument", "block").applyInArrow(each, schema)


def at_events(events: DataFrame, bars: DataFrame, columns: tuple[str, ...], before: int, after: int, run: Callable[[Bars, pa.Table, np.ndarray], dict], out: str, size: int = SIZE) -> DataFrame:
    """What ``run(bars, events, at)`` gives for the events of each block, ``at`` being where their bars ``i`` stand; an event without its bar is left out."""
    schema, arrow = _schemas(bars, out)
    names = events.columns

    def each(key, table, given):
        block = Bars(table.rename_columns([c[1:] for c in table.schema.names]), columns, key[1].as_py(), size)
        i = given.column("i").to_numpy()
        at = np.searchsorted(block.i, i)
        there = np.flatnonzero((at < len(block)) & (block.i[np.minimum(at, max(0, len(block) - 1))] == i)) if len(block) else np.zeros(0, np.int64)
        return _built(run(block, given.select(names).take(pa.array(there)), at[there]), key[0].as_py(), arrow)

    # other names and other columns than those of events that come from the same bars
    left = _spread(bars, columns, before, after, size)
    left = left.toDF(*(f"_{c}" for c in left.columns)).groupBy("_instrument", "_block")
    right = events.withColumn("block", F.floor(F.col("i") / size)).groupBy("instrument", "block")
    return left.cogroup(right).applyInArrow(each, schema)


# ---- rules over arrays


def extreme_around(values: np.ndarray, k: int, low: bool) -> np.ndarray:
    """Whether a bar goes strictly beyond the k bars before it and at least as far as the k after; false where they aren't all there."""
    x = -values if low else values
    out = np.zeros(len(x), bool)
    if len(x) <= 2 * k:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(x, k)
    most = windows.max(axis=1)
    mid = slice(k, len(x) - k)
    out[mid] = (x[mid] > most[: len(x) - 2 * k]) & (x[mid] >= most[k + 1 :][: len(x) - 2 * k])
    return out


def running(values: np.ndarray, start: np.ndarray, n: int, low: bool) -> np.ndarray:
    """For each start the running maximum (or minimum) of its next n values, itself included; what lies past the end changes nothing."""
    at = start[:, None] + np.arange(n)
    rows = np.where(at < len(values), values[np.minimum(at, len(values) - 1)], np.inf if low else -np.inf)
    return (np.minimum if low else np.maximum).accumulate(rows, axis=1)


def first_reach(extremes: np.ndarray, price: np.ndarray, low: bool) -> np.ndarray:
    """At which value, counted from 1, running extremes first reach a price; 0 if never.  By halving, for all rows at once."""
    n = extremes.shape[1]
    lo, hi, rows = np.zeros(len(price), np.int64), np.full(len(price), n), np.arange(len(price))
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, n - 1)
        there = extremes[rows, mid] <= price if low else extremes[rows, mid] >= price
        open_ = lo < hi
        hi = np.where(open_ & there, mid, hi)
        lo = np.where(open_ & ~there, mid + 1, lo)
    return np.where(lo < n, lo + 1, 0)


class Ahead:
    """Where values next go beyond a price: maxima (or minima) of runs of 1, 2, 4, ... values answer each question in as many steps as runs have doublings."""

    def __init__(self, values: np.ndarray, low: bool = False):
        self.sign = -1.0 if low else 1.0
        self.levels = [values * self.sign]
        while len(self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def first(self, start: np.ndarray, price: np.ndarray, strict: bool = False) -> np.ndarray:
        """The first place from start on with a value beyond (or, not strict, at) price; the number of values if there is none."""
        at, aim, n = start.astype(np.int64).copy(), price * self.sign, len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            there = np.flatnonzero(at < len(level))
            most = level[at[there]]
            short = most <= aim[there] if strict else most < aim[there]
            at[there[short]] += 1 << k
        return np.minimum(at, n)

    def extreme(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The furthest value of start..end-1; nan where that is nothing."""
        out = np.full(len(start), np.nan)
        length = np.minimum(end, len(self.levels[0])) - start
        for k in range(len(self.levels)):
            own = np.flatnonzero((length >= 1 << k) & (length < 2 << k))
            if len(own):
                a = start[own]
                out[own] = np.maximum(self.levels[k][a], self.levels[k][a + length[own] - (1 << k)]) * self.sign
        return out


def first_beyond(events: DataFrame, bars: DataFrame, strict: bool = False, size: int = SIZE) -> DataFrame:
    """events (instrument, i, level, up, ...) with ``found_i``, the first bar after i whose high (low, where not up) is at or beyond level, and ``extreme``, the furthest such price after i: to the end of the series, however far.

    A block answers what lies inside it; a series' table of block extremes, a row a block, names the block for
    the rest, and that block the bar.
    """
    columns = events.columns
    ends = bars.groupBy("instrument", F.floor(F.col("i") / size).alias("b")).agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    ends = ends.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("b", "hi", "lo"))).alias("_ends"))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def inside(block: Bars, given: pa.Table, at: np.ndarray) -> dict:
        up, level = given.column("up").to_numpy(), given.column("level").to_numpy()
        found, extreme = np.full(len(at), -1), np.full(len(at), np.nan)
        for side, name in ((True, "high"), (False, "low")):
            own = np.flatnonzero(up == side)
            ahead, start = Ahead(block[name], low=not side), at[own] + 1
            place = ahead.first(start, level[own], strict)
            found[own] = np.where(place < len(block), block.first + place, -1)
            extreme[own] = ahead.extreme(start, np.full(len(own), len(block)))
        return {c: given.column(c) for c in columns} | {"found_i": np.where(found >= 0, found, np.nan), "extreme": extreme}

    near = at_events(events, bars, ("high", "low"), 0, 0, inside, f"{plain}, found_i long, extreme double", size)
    later = F.slice("_ends", (F.floor(F.col("i") / size) + 2).cast("int"), F.size("_ends"))
    rows = near.join(ends, "instrument").withColumn("_later", later)
    up, level = F.col("up"), F.col("level")

    def reaches(x):
        return F.when(up, x["hi"] > level).otherwise(x["lo"] < level) if strict else F.when(up, x["hi"] >= level).otherwise(x["lo"] <= level)

    nth = F.array_position(F.transform("_later", reaches), True)
    rows = rows.withColumn("_block", F.when(F.isnull("found_i") & (nth > 0), F.floor(F.col("i") / size) + nth))
    most = F.when(up, F.array_max(F.transform("_later", lambda x: x["hi"]))).otherwise(F.array_min(F.transform("_later", lambda x: x["lo"])))
    rows = rows.withColumn("extreme", F.when(up, F.greatest("extreme", most)).otherwise(F.least("extreme", most)))
    asked = rows.select(*(c for c in columns if c != "i"), F.col("i").alias("_i"), "found_i", "extreme", F.coalesce(F.col("_block") * size, "i").cast("long").alias("i"), F.isnotnull("_block").alias("_look"))

    def there(block: Bars, given: pa.Table, at: np.ndarray) -> dict:
        look, up, level = (given.column(c).to_numpy(zero_copy_only=False) for c in ("_look", "up", "level"))
        found = given.column("found_i").to_numpy().astype(np.float64)
        for side, name in ((True, "high"), (False, "low")):
            own = np.flatnonzero(look & (up == side))
            if len(own):
                found[own] = block.first + Ahead(block[name], low=not side).first(at[own], level[own], strict)
        return {c: given.column("_i" if c == "i" else c) for c in columns} | {"found_i": found, "extreme": given.column("extreme").to_numpy()}

    return at_events(asked, bars, ("high", "low"), 0, 0, there, f"{plain}, found_i long, extreme double", size)


def ranks_in_windows(values: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place ``at`` how many values of start..end-1 are less than the one there, and how many are equal.

    Values become numbers of their order; bit by bit, from the highest, all of them are dealt stably into zeros and
    ones, and counts of zeros carry every window to its place in the next deal: as many passes as numbers have bits,
    whatever the length of the windows.
    """
    order = np.unique(values, return_inverse=True)[1]
    own, less = order[at], np.zeros(len(at), np.int64)
    lo, hi, now = start.astype(np.int64).copy(), end.astype(np.int64).copy(), order
    for bit in range(max(1, int(order.max(initial=0)).bit_length()) - 1, -1, -1):
        ones = (now >> bit) & 1
        zeros = np.r_[0, np.cumsum(1 - ones)]
        lo0, hi0, up = zeros[lo], zeros[hi], ((own >> bit) & 1).astype(bool)
        less += np.where(up, hi0 - lo0, 0)
        lo, hi = np.where(up, zeros[-1] + lo - lo0, lo0), np.where(up, zeros[-1] + hi - hi0, hi0)
        now = np.r_[now[ones == 0], now[ones == 1]]
    return less, hi - lo


def with_block_columns(bars: DataFrame, columns: tuple[str, ...], before: int, run: Callable[[Bars], dict[str, np.ndarray]], added: str, size: int = SIZE) -> DataFrame:
    """bars with the columns that ``run`` gives for the own bars of each block, which sees ``before`` bars before them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = bars.columns
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema)
    schema = bars.sparkSession.createDataFrame([], f"{plain}, {added}").schema
    arrow = to_arrow_schema(schema)

    def each(key, table):
        block = Bars(table, columns, key[1].as_py(), size)
        order = np.argsort(table.column("i").to_numpy(), kind="stable")[block.own]
        own = table.select(names).take(pa.array(order))
        return _built({c: own.column(c) for c in names} | run(block), key[0].as_py(), arrow)

    others = tuple(c for c in names if c not in ("instrument", "i"))
    return _spread(bars, others, before, 0, size).groupBy("instrument", "block").applyInArrow(each, schema)
