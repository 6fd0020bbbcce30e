"""Compressed tick files, platform trade lists and roll plans."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One tick: milliseconds into the hour, ask and bid as integers, ask and bid volume; big-endian.
TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])


def read_tick_files(spark: SparkSession, path: str, instrument: str, factor: float) -> DataFrame:
    """Ticks of LZMA files named ``...yyyyMMddHH...``; a file whose length is no multiple of a tick is an error, an empty one has none."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for hour, name, content in batch[["hour", "path", "content"]].itertuples(index=False):
                raw = lzma.decompress(content) if content else b""
                if len(raw) % TICK.itemsize:
                    raise ValueError(f"{name}: {len(raw)} bytes are no whole number of ticks")
                rows = np.frombuffer(raw, TICK)
                at = pd.Timestamp(hour) + pd.to_timedelta(rows["ms"].astype("int64"), unit="ms")
                yield pd.DataFrame({"ts": at, "ask": rows["ask"] / factor, "bid": rows["bid"] / factor, "ask_volume": rows["ask_volume"].astype(float), "bid_volume": rows["bid_volume"].astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content", F.to_timestamp_ntz(F.regexp_extract("path", r"([0-9]{10})[^/]*$", 1), F.lit("yyyyMMddHH")).alias("hour"))
    ticks = files.mapInPandas(decode, "ts timestamp_ntz, ask double, bid double, ask_volume double, bid_volume double")
    return ticks.withColumn("instrument", F.lit(instrument))


def quotes_to_minutes(ticks: DataFrame) -> DataFrame:
    """Minute bars of the mid price, labelled with the minute's end; volume is what both sides offer."""
    mid = (F.col("ask") + F.col("bid")) / 2
    rows = ticks.withColumn("mid", mid).withColumn("end", F.window("ts", "1 minute")["end"])
    order = F.struct("ts", "ask", "bid", "ask_volume", "bid_volume")
    return rows.groupBy("instrument", F.col("end")).agg(
        F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"), F.sum(F.col("ask_volume") + F.col("bid_volume")).alias("volume")
    ).withColumnRenamed("end", "ts")


def read_trade_list(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Trades of a platform's list: the entry and the exit row of each number, joined; open trades have no exit."""
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    wanted = {"trade #": "number", "type": "type", "signal": "signal", "date/time": "at", "price usd": "price", "contracts": "contracts", "profit usd": "profit"}
    names = {c: wanted[c.strip().lower()] for c in raw.columns if c.strip().lower() in wanted}
    rows = raw.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rows = rows.select(F.col("number").cast("long").alias("number"), F.lower("type").alias("type"), F.expr("try_cast(at as timestamp_ntz)").alias("at"), *(F.regexp_replace(c, "[^0-9.+-]", "").cast("double").alias(c) for c in ("price", "contracts", "profit")))
    entry = rows.filter(F.col("type").startswith("entry")).select("number", F.when(F.col("type").contains("short"), -1).otherwise(1).alias("direction"), F.col("at").alias("entry_at"), F.col("price").alias("entry"), "contracts")
    leave = rows.filter(F.col("type").startswith("exit")).select("number", F.col("at").alias("exit_at"), F.col("price").alias("exit"), "profit")
    return entry.join(leave, "number", "left")


def roll_plan(expiries: DataFrame, days_before: int = 8) -> DataFrame:
    """From contracts (root, contract, expiry) the interval in which each is the front one."""
    w = Window.partitionBy("root").orderBy("expiry")
    until = F.date_sub("expiry", days_before)
    rows = expiries.withColumn("until", until)
    return rows.withColumn("since", F.lag("until").over(w)).select("root", "contract", "since", "until")


def front_contract(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """bars with the contract whose interval holds them; the days of each interval are listed, so days are joined, not ranges."""
    days = plan.filter("since is not null").select("root", "contract", F.explode(F.sequence("since", F.date_sub("until", 1))).alias("day"))
    return bars.withColumn("day", F.to_date("ts")).join(days.withColumnRenamed("root", "instrument"), ["instrument", "day"], "left").drop("day")
