"""Readers of tick files, trade lists and roll plans."""

import datetime as dt
import lzma

import numpy as np
import pytest

from barspark.sources import files


def test_tick_files(spark, tmp_path):
    rows = np.array([(500, 100100, 100000, 1.0, 2.0), (61000, 100300, 100200, 1.5, 0.5)], files.TICK)
    (tmp_path / "x_2024010214.bi5").write_bytes(lzma.compress(rows.tobytes()))
    (tmp_path / "x_2024010215.bi5").write_bytes(b"")
    bars = files.quotes_to_minutes(files.read_tick_files(spark, str(tmp_path / "*.bi5"), "X", 1000.0)).orderBy("ts").collect()
    assert [(str(b.ts), round(b.close, 6), b.volume) for b in bars] == [("2024-01-02 14:01:00", 100.05, 3.0), ("2024-01-02 14:02:00", 100.25, 2.0)]


def test_broken_tick_file(spark, tmp_path):
    (tmp_path / "x_2024010214.bi5").write_bytes(lzma.compress(b"123"))
    with pytest.raises(Exception, match="no whole number"):
        files.read_tick_files(spark, str(tmp_path / "*.bi5"), "X", 1000.0).count()


def test_trade_list(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Trade #,Type,Signal,Date/Time,Price USD,Contracts,Profit USD\n1,Entry Short,S,2024-01-02 10:00:00,100,2,\n1,Exit Short,X,2024-01-02 11:00:00,90,2,20\n2,Entry Long,S,2024-01-03 10:00:00,95,1,\n")
    got = files.read_trade_list(spark, str(tmp_path / "t.csv")).orderBy("number").collect()
    assert [(r.direction, r.entry, r.exit, r.profit) for r in got] == [(-1, 100.0, 90.0, 20.0), (1, 95.0, None, None)]


def test_roll_plan(spark):
    expiries = spark.createDataFrame([("ES", "H4", dt.date(2024, 3, 15)), ("ES", "M4", dt.date(2024, 6, 21))], "root string, contract string, expiry date")
    bars = spark.createDataFrame([("ES", dt.datetime(2024, 4, 1)), ("ES", dt.datetime(2024, 6, 13)), ("ES", dt.datetime(2024, 3, 7))], "instrument string, ts timestamp_ntz")
    got = {str(r.ts.date()): r.contract for r in files.front_contract(bars, files.roll_plan(expiries)).collect()}
    assert got == {"2024-04-01": "M4", "2024-06-13": None, "2024-03-07": "M4"}
