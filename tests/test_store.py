"""Bar requests, timeframes, contract names and trading days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barspark.functions import exchange_days as ex
from barspark.functions import sessions as se
from barspark.functions import timeframes as tf
from barspark.sources import store


def test_timeframes():
    assert [tf.normalized(x) for x in ("60m", " 240M ", "day", "5m", "2h")] == ["1h", "4h", "1d", "5m", "2h"]
    assert tf.timeframe_of(15) == "15m" and tf.minutes_of("4h") == 240 and tf.minutes_of("1d") == 1380
    for bad in ("7x", "", "h"):
        with pytest.raises(ValueError):
            tf.normalized(bad)
    with pytest.raises(ValueError):
        tf.timeframe_of(7)


def test_requests(spark, tmp_path):
    at = dt.datetime(2024, 1, 15, 15)
    rows = [("X", at + dt.timedelta(minutes=k), 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 3.0) for k in range(1, 181)] + [("Y", at, 1.0, 1.0, 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    bars.write.parquet(str(tmp_path / "t"))
    request = store.Request("X", 60, at + dt.timedelta(hours=2), at + dt.timedelta(hours=3))
    got = store.read_bars(spark, "table", str(tmp_path / "t"), request)
    assert [(r.ts.hour, r.open, r.close, r.volume) for r in got.orderBy("ts").collect()] == [(17, 62.0, 121.5, 180.0), (18, 122.0, 181.5, 180.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts," in plan and "EqualTo(instrument,X)" in plan
    store.write_csv(got, str(tmp_path / "c"))
    again = store.read_bars(spark, "csv", str(tmp_path / "c"), store.Request("X", 1, most=1)).collect()
    assert [(r.ts.hour, r.close) for r in again] == [(18, 181.5)]
    with pytest.raises(KeyError):
        store.read_bars(spark, "nowhere", "", request)
    none = store.Request("Z")
    with pytest.raises(LookupError):
        store.checked(store.read_table(spark, str(tmp_path / "t"), none), none)
    stored = bars.limit(0).withColumn("timeframe", F.lit("1h"))
    assert store.stored_or_built(stored, bars, "1h", 2).filter("instrument = 'X'").count() == 2
    events = spark.createDataFrame([("a", 1), ("b", 2)], "pattern string, i long")
    store.write_events(events, str(tmp_path / "e"))
    store.write_events(events.filter("pattern = 'a'").withColumn("i", F.lit(5).cast("long")), str(tmp_path / "e"))
    assert {(r.pattern, r.i) for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {("a", 5), ("b", 2)}


def test_names(spark):
    names = ["mnq sep19", "MNQ 09-26.Last.txt", "ES_DEC2024", "MNQ 0926", "MNQ 13-26", "x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(store.contract(F.col("n")).alias("c"), store.canonical(F.col("n"), {"x": "X1"}).alias("s")).collect()
    assert [tuple(r.c) if r.c else None for r in rows] == [("MNQ", 2019, 9), ("MNQ", 2026, 9), ("ES", 2024, 12), None, None, None]
    assert rows[-1].s == "X1" and rows[0].s == "mnq sep19"


def test_trading_days(spark):
    days = {r.day: r.early for r in ex.trading_days(spark, "2023-12-20", "2025-04-30").collect()}
    closed = [dt.date(2023, 12, 25), dt.date(2024, 1, 1), dt.date(2024, 3, 29), dt.date(2025, 4, 18), dt.date(2024, 6, 1)]
    early = [dt.date(2024, 1, 15), dt.date(2024, 2, 19), dt.date(2024, 5, 27), dt.date(2024, 6, 19), dt.date(2024, 7, 4), dt.date(2024, 9, 2), dt.date(2024, 11, 28), dt.date(2024, 11, 29), dt.date(2024, 12, 24)]
    assert not any(d in days for d in closed) and all(days[d] for d in early) and sum(days.values()) == len(early) + 2  # and two holidays of early 2025
    row = spark.range(1).select(ex.next_trading_day(F.lit("2024-03-29").cast("date")).alias("n")).first()
    assert row.n == dt.date(2024, 4, 1)


def test_session_times(spark):
    at = lambda *x: dt.datetime(*x)
    rows = spark.createDataFrame([(at(2024, 1, 16, 15, 0),), (at(2024, 1, 16, 23, 30),), (at(2024, 1, 20, 12, 0),), (at(2024, 7, 5, 13, 30),)], "ts timestamp_ntz")
    ts = F.col("ts")
    a, b = se.session_bounds(se.session_date(ts))
    got = rows.select(se.minutes_until_rth_open(ts), se.minutes_until_rth_close(ts), se.minutes_until_maintenance(ts), se.is_liquid(ts), se.is_first_hour(ts), se.is_thin(ts), se.is_overnight(ts), a, b, se.floor_to(ts, 60)).collect()
    assert tuple(got[0])[:7] == (0.0, 360.0, 420.0, True, False, False, False)
    assert tuple(got[1])[:7] == (900.0, None, 1350.0, False, True, False, True)
    assert tuple(got[2])[:2] == (3030.0, None)
    assert tuple(got[3])[:2] == (0.0, 390.0)
    assert got[0][7:] == (at(2024, 1, 15, 23), at(2024, 1, 16, 23), at(2024, 1, 16, 15)) and got[3][7] == at(2024, 7, 4, 22)
