"""Bars, ticks and trades from the given tables, and readers of the usual bar formats.

A bar has instrument, ts (the end of its bucket), i (its number within the instrument), open, high, low, close
and volume.  Ties within a bucket are broken by the event id, so first and last are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of columns in files, and the columns that they stand for; fixed.
HEADER_NAMES = {"last": "close", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume"}
#: Names of time columns, the first one there counts; fixed.
TIME_NAMES = ("timestamp", "time", "datetime", "date", "ts")


def series(*keys: str) -> "Window":
    """The window of one instrument's bars in time order."""
    return Window.partitionBy(*(keys or ("instrument",))).orderBy("ts")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: instrument, ts, event_id, price."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_type").alias("instrument"), "ts", "event_id", "user_id", F.col("value").alias("price"))


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(series()).cast("long") - 1)


def ticks_to_bars(rows: DataFrame, width: str, ts: str = "ts") -> DataFrame:
    """Bars labelled with the end of their bucket; empty buckets have no bar."""
    order = F.struct(ts, "event_id")
    return rows.groupBy("instrument", F.window(ts, width)["end"].alias("end")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.count("*").cast("double").alias("volume"),
    ).withColumnRenamed("end", "ts")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ticks_to_bars(ticks(spark, sf_dir), "1 hour"))


def read_csv_bars(spark: SparkSession, path: str, instrument: str) -> tuple[DataFrame, DataFrame]:
    """Bars of CSV files with a header, and their rows whose time can't be read.

    Header names are lower-cased and resolved by alias; the first known time column counts; a missing volume is 0;
    of rows with one time the last in the file stays, and of several files the one that is last by name.
    """
    raw = spark.read.option("header", True).csv(path)
    lowered = {c: c.strip().lower() for c in raw.columns}
    # an alias stands in only where the column itself is missing
    names = {c: n if HEADER_NAMES.get(n) in lowered.values() else HEADER_NAMES.get(n, n) for c, n in lowered.items()}
    # in a file rows go by the block that a task reads and by their number there
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = raw.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), place.alias("_row"))
    time = next((t for t in TIME_NAMES if t in rows.columns), None)
    if time is None:
        raise ValueError(f"no time column among {rows.columns}")
    volume = F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) if "volume" in rows.columns else F.lit(0.0)
    rows = rows.withColumn("_at", F.expr(f"try_cast({time} as timestamp_ntz)"))
    bars = rows.filter("_at is not null").select(F.lit(instrument).alias("instrument"), F.col("_at").alias("ts"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), volume.alias("volume"), "_row")
    last = Window.partitionBy("instrument", "ts").orderBy(F.desc("_row"))
    return bars.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_row"), rows.filter("_at is null").drop("_at", "_row")


def read_vendor_export(spark: SparkSession, path: str, instrument: str, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Bars of text lines ``yyyyMMdd HHmmss;o;h;l;c;v`` (or with commas; compressed files too), and the lines that don't parse."""
    parts = spark.read.text(path).withColumn("p", F.split(F.trim("value"), "[;,]"))
    time = F.expr("try_to_timestamp(p[0], 'yyyyMMdd HHmmss')").cast("timestamp_ntz")
    numbers = [F.expr(f"try_cast(try_element_at(p, {k}) as double)") for k in range(2, 7)]
    rows = parts.withColumn("ts", time)
    for name, x in zip(("open", "high", "low", "close", "volume"), numbers, strict=True):
        rows = rows.withColumn(name, x)
    fine = F.col("ts").isNotNull() & F.col("close").isNotNull() & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("volume").isNotNull()
    local = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("ts"))
    good = rows.filter(fine).select(F.lit(instrument).alias("instrument"), local.alias("ts"), "open", "high", "low", "close", "volume")
    return good, rows.filter(~F.coalesce(fine, F.lit(False))).select("value")


def newest(bars: DataFrame, n: int, before=None) -> DataFrame:
    """The newest n bars of each instrument before a time."""
    rows = bars if before is None else bars.filter(F.col("ts") < before)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("ts")))).filter(F.col("_k") <= n).drop("_k")
