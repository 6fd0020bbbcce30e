"""Streams of ticks and bars: bars by watermark, idempotent upserts, a per-series state."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barspark.operators.levels import upserted


def tick_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files as they arrive; times become TIMESTAMP, which a watermark asks for."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def bar_stream(ticks: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Bars of a stream, each once it can't change any more; ticks later than ``delay`` are left out."""
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy("instrument", F.window("ts", width)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("instrument", F.col("window.end").alias("ts"), "open", "high", "low", "close", "volume")


BUCKETS = 32


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rows of an upserted table: of each bucket its last version (before a batch's number)."""
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.filter(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # a row a bucket
    return rows.join(F.broadcast(newest), ["bucket", "version"]).drop("bucket", "version")


def upsert_stream(rows: DataFrame, path: str, keys: list[str], received: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in a table of ``BUCKETS`` buckets; a batch writes a new version of the buckets that it touches.

    A batch reads the versions before its own number only, so one that is replayed writes the same again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
        if number and not there:
            raise RuntimeError(f"batch {number} finds no table at {path}")
        arrived = place(batch)
        merged = arrived
        if there:
            touched = arrived.select("bucket").distinct()
            merged = upserted(place(latest(spark, path, number)).join(touched, "bucket", "left_semi").select(*arrived.columns), arrived, keys, received)
        else:
            merged = upserted(arrived.limit(0), arrived, keys, received)
        out = merged.withColumn("version", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunningExtremes(StatefulProcessor):
    """Per instrument the highest and lowest price so far and the number of new extremes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("extremes", "high double, low double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        high, low, n = self.state.get() if self.state.exists() else (None, None, 0)
        for part in rows:
            for price in part.sort_values(["ts", "event_id"])["price"]:
                fresh = high is None or price > high or price < low
                high, low = (price, price) if high is None else (max(high, price), min(low, price))
                n += fresh
        self.state.update((float(high), float(low), int(n)))
        yield pd.DataFrame({"instrument": [key[0]], "high": [high], "low": [low], "n": [n]})

    def close(self) -> None:
        pass


class ClosedBars(StatefulProcessor):
    """Per instrument the open bars; a bar closes once a tick ``delay`` past its end has come, and a tick of a closed bar is late.

    What is closed is fixed when a batch begins, so ticks of one batch never make each other late.  Open bars are few: those
    of the last ``delay``.
    """

    BAR = "open double, open_at long, open_id long, high double, low double, close double, close_at long, close_id long, volume long"

    def __init__(self, width: int, delay: int):
        self.width, self.delay = width, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "newest long, closed long")
        self.bars = handle.getMapState("bars", "end long", self.BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, closed = self.seen.get() if self.seen.exists() else (-(2**62), -(2**62))
        late, touched = [], {}
        for part in rows:
            for at, event, price in zip(part["at"].tolist(), part["event_id"].tolist(), part["price"].tolist(), strict=True):
                newest = max(newest, at)
                end = (at // self.width + 1) * self.width
                if end <= closed:
                    late.append((at, event, price))
                    continue
                if end not in touched:
                    touched[end] = self.bars.getValue((end,)) if self.bars.containsKey((end,)) else None
                b = touched[end]
                if b is None:
                    touched[end] = (price, at, event, price, price, price, at, event, 1)
                    continue
                first = (price, at, event) if (at, event) < (b[1], b[2]) else tuple(b[:3])
                last = (price, at, event) if (at, event) > (b[6], b[7]) else tuple(b[5:8])
                touched[end] = (*first, max(b[3], price), min(b[4], price), *last, b[8] + 1)
        for end, b in touched.items():
            self.bars.updateValue((end,), tuple(b))
        closed = max(closed, newest - self.delay)
        done = sorted(k[0] for k in self.bars.keys() if k[0] <= closed)
        out = []
        for end in done:
            b = self.bars.getValue((end,))
            out.append(("bar", end, None, b[0], b[3], b[4], b[5], b[8]))
            self.bars.removeKey((end,))
        self.seen.update((newest, closed))
        out += [("late", at, event, price, price, price, price, 1) for at, event, price in late]
        columns = ["kind", "at", "event_id", "open", "high", "low", "close", "volume"]
        found = pd.DataFrame(out, columns=columns).astype({"event_id": "Int64"})
        found.insert(1, "instrument", key[0])
        yield found

    def close(self) -> None:
        pass


def bars_and_late(ticks: DataFrame, width_minutes: int = 60, delay_minutes: int = 120) -> DataFrame:
    """A stream of closed bars (kind bar) and of the ticks that came too late for theirs (kind late): none is lost.

    ``bar_stream`` leaves late ticks out, as a watermark does; here each instrument's newest tick is its clock.
    """
    out = "kind string, instrument string, at long, event_id long, open double, high double, low double, close double, volume long"
    rows = ticks.select("instrument", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), "price")
    minute = 60_000_000
    return rows.groupBy("instrument").transformWithStateInPandas(ClosedBars(width_minutes * minute, delay_minutes * minute), out, "Append", "None").withColumn("ts", F.timestamp_micros("at")).drop("at")


def write_bars_and_late(stream: DataFrame, bars_path: str, late_path: str, checkpoint: str) -> StreamingQuery:
    """Bars to one table and late ticks to another, each batch under its number: one that is replayed writes the same again."""

    def both(batch: DataFrame, number: int) -> None:
        for kind, path in (("bar", bars_path), ("late", late_path)):
            rows = batch.filter(F.col("kind") == kind).drop("kind").withColumn("batch", F.lit(number).cast("long"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extremes_stream(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("instrument").transformWithStateInPandas(RunningExtremes(), "instrument string, high double, low double, n long", "Update", "None")


def drained(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote."""
    os.makedirs(checkpoint, exist_ok=True)
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
