"""Guards, placebos, statistics and rule details on small hand-worked cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barspark.operators import events as ev
from barspark.operators import measure as me
from barspark.operators import research as rs
from barspark.operators import rules as ru
from barspark.operators import strategies as sg
from barspark.operators import validation as va

BAR = "instrument string, i long, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars_of(spark, rows):
    at = dt.datetime(2024, 1, 16, 15)
    return spark.createDataFrame([("x", k, at + dt.timedelta(hours=k), *map(float, r), 1.0) for k, r in enumerate(rows)], BAR)


def test_guards(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 2, 3)], "ts timestamp_ntz")
    day = lambda d: dt.datetime(2024, 1, d)
    assert va.only_before(rows, day(4)).count() == 3 and va.only_within(rows, day(1), day(4)).count() == 3
    for bad in (lambda: va.only_before(rows, day(3)), lambda: va.only_within(rows, day(2), day(4)), lambda: va.only_within(rows, day(1), day(3))):
        with pytest.raises(ValueError):
            bad()
    assert va.only_before(rows.limit(0), day(1)).count() == 0
    assert va.grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]


def test_columns_come_before_the_cut(spark):
    bars = bars_of(spark, [(k, k + 1, k - 1, k) for k in range(10)])
    inside, outside = va.prepared_then_cut(bars, lambda b: b.withColumn("sma", F.avg("close").over(ru.series().rowsBetween(-2, 0))), F.lit(dt.datetime(2024, 1, 16, 20)).cast("timestamp_ntz"))
    assert inside.count() == 5 and outside.orderBy("i").first().sma == 4.0  # of bars 3, 4 and 5


def test_rules(spark):
    # atr 1, reference 0: out at -2, back inside at -1, through at 1
    rows = bars_of(spark, [(0, 0, 0, c) for c in (-2.0, -1.0, -0.5, 1.0, 2.0, 1.0, -2.0, 1.0)]).withColumn("vwap", F.lit(0.0)).withColumn("atr", F.lit(1.0)).withColumn("bars_in_trade", F.col("i"))
    below, above = ru.Reentry("close", "vwap", "atr", 1.5, -1), ru.Reentry("close", "vwap", "atr", 1.5, 1)
    got = rows.select("i", below.column().alias("b"), above.column().alias("a"), ru.Always().column().alias("t"), ru.HeldFor(6).column().alias("h"), ru.CrossesAbove("close", "vwap", 0.5).column().alias("c"), ru.Above("close", 0.5, 0.4).column().alias("o")).orderBy("i").collect()
    assert [r.i for r in got if r.b] == [1] and [r.i for r in got if r.a] == [5] and all(r.t for r in got) and [r.i for r in got if r.h] == [6, 7]
    assert [r.i for r in got if r.c] == [3, 7] and [r.i for r in got if r.o] == [3, 4, 5, 7]
    assert below.names() == {"close", "vwap", "atr"}


def test_library(spark):
    assert len(sg.LIBRARY) == 9
    for wrong in (lambda: sg.build("x"), lambda: sg.with_stop(sg.build("vwap_trend"), "x"), lambda: sg.ideas(bars_of(spark, [(1, 1, 1, 1)]), ("x",))):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError, match="vwap"):
        sg.entries(bars_of(spark, [(1, 1, 1, 1)]), [sg.build("vwap_trend")])


def test_level_interactions(spark):
    """One level at 100 with ATR 10: from below a test, a break, a retest and a false break; a close beyond the buffer on the old side is no test."""
    closes = [(80, 80, 80, 80), (80, 99.5, 80, 99.5), (99, 99.2, 95, 95), (95, 105, 95, 105), (105, 106, 100.5, 104), (104, 104, 90, 92), (92, 93, 80, 85)]
    rows = [("x", "l", k, *map(float, r[1:]), 80.0 if not k else float(closes[k - 1][3]), 10.0, 100.0) for k, r in enumerate(closes)]
    levels = spark.createDataFrame(rows, "instrument string, name string, i long, high double, low double, close double, prev_close double, atr double, level double")
    got = [(r.i, r.kind, r.direction, r.origin) for r in ev.level_interactions(levels).orderBy("i", "kind").collect()]
    assert got == [(1, "test", -1, 1), (3, "break", 1, 3), (4, "retest", 1, 3), (5, "false_break", -1, 3)]


def test_placebo_and_matches(spark):
    events = spark.createDataFrame([("x", k, 1, "p") for k in range(1000, 1200)], "instrument string, i long, direction long, pattern string")
    moved = me.placebo(events.withColumn("origin", F.col("i")), 24).collect()
    assert len(moved) == 200 and {abs(r.i - r.origin) for r in moved} == {24 * d for d in range(1, 6)} and {r.pattern for r in moved} == {"placebo_p"}
    spans = spark.createDataFrame([(k, "x", k * 3, k * 3 + k) for k in range(20)], "id long, instrument string, first_i long, last_i long")
    series = spark.createDataFrame([("x", k) for k in range(100)], "instrument string, i long")
    got = {r.id: r for r in me.length_matched(spans, series).collect()}
    assert all(r.last_i - r.first_i == k and 0 <= r.first_i and r.last_i < 100 for k, r in got.items()) and len(got) == 20
    met = {(r.id, r.other) for r in me.overlapping(spans, spans).collect()}
    want = {(a, b) for a in range(20) for b in range(20) if min(4 * a, 4 * b) - max(3 * a, 3 * b) + 1 > 0.5 * (a + 1)}
    assert met == want


def test_statistics(spark):
    # known values: t of 2 with 10 degrees of freedom, z of 1.96
    assert rs.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-8) and rs.t_p_value(0.0, 5) == 1.0 and rs.t_p_value(-12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    rates = spark.createDataFrame([(1.959964, 0.0, 2.0, 0.0, 11, 11)], "share_z double, share_z_overlapping double, t double, t_overlapping double, n_independent long, n long")
    row = ev.with_rate_p_values(rates).first()
    assert row.share_p == pytest.approx(0.05, abs=1e-6) and row.share_p_overlapping == 1.0 and row.p == pytest.approx(0.07338803, abs=1e-8) and row.p_overlapping == 1.0
    tested = spark.createDataFrame([(11, 2.0), (11, 5.0)], "n long, t double")
    assert {r.t: r.significant for r in rs.with_p_values(tested).collect()} == {2.0: False, 5.0: True}


def test_vintages(spark):
    raw = spark.createDataFrame([("a", 1, "1.5"), ("a", 2, "."), ("a", 3, "2"), ("b", 1, "x")], "series string, at int, value string")
    got = sorted((r.series, r["at"], r.value, r.revision) for r in rs.decoded_vintages(raw, ["series"], "at").collect() if r.value is not None)
    assert got == [("a", 1, 1.5, 1), ("a", 3, 2.0, 2)]


def test_trade_summary_edges(spark):
    trades = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1), 5.0, 1), ("b", 1, dt.datetime(2024, 1, 1), -2.0, 3), ("b", 2, dt.datetime(2024, 1, 2), 0.0, 1)], "s string, k long, ts timestamp_ntz, pnl double, bars_held long")
    got = {r.s: r for r in va.trade_summary(trades, "s", ["ts", "k"], 10.0, 100.0).collect()}
    assert math.isinf(got["a"].profit_factor) and got["a"].sharpe_pnl is None and got["a"].max_drawdown_pct == 0.0
    assert got["b"].profit_factor == 0.0 and got["b"].max_consecutive_losses == 2 and got["b"].max_drawdown_pct is None and got["b"].exposure_pct == 40.0


def test_pattern_comparison(spark):
    closes = [100 + 5 * math.sin(k / 3) for k in range(400)]
    bars = bars_of(spark, [(c, c + 2, c - 2, c) for c in closes])
    null = me.null_line(bars, horizon=24)
    events = bars.filter("i % 7 = 0").select("instrument", "i", F.lit(1).cast("long").alias("direction"), F.lit("p").alias("pattern"))
    got = me.pattern_comparison(events, bars, null, least_decided=1)
    assert null.count() == 50 and 0 < got.count() <= 25 and got.filter("abs(edge - (expectancy - null_expectancy)) > 1e-9").count() == 0
