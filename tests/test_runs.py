"""Whole runs, the register, exports, front contracts, vintages, CSV order and late ticks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barspark.operators import contracts, costs, research, research_run
from barspark.sources import runs, store
from barspark.sources.bars import read_csv_bars
from barspark.streaming import bars as st


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    events = spark.createDataFrame([(1, "a"), (2, "b")], "event long, pattern string")
    broken = events.withColumn("x", F.raise_error(F.lit("killed")))
    with pytest.raises(Exception, match="killed"):
        runs.write_run(root, "r1", {"events": events, "outcomes": broken})
    assert runs.runs(spark, root).count() == 0
    with pytest.raises(LookupError):
        runs.read_table(spark, root, "events")
    assert runs.write_run(root, "r1", {"events": events, "outcomes": events.limit(1)}, "second try")
    assert not runs.write_run(root, "r1", {"events": events.limit(0), "outcomes": events})
    assert runs.write_run(root, "r2", {"events": events.filter("event = 2")})
    assert sorted((r.run, r.event) for r in runs.read_table(spark, root, "events").collect()) == [("r1", 1), ("r1", 2), ("r2", 2)]
    assert runs.read_table(spark, root, "outcomes").count() == 1
    assert {r.run: r.tables for r in runs.runs(spark, root).collect()} == {"r1": '{"events": 2, "outcomes": 1}', "r2": '{"events": 1}'}


def test_a_broken_manifest_hides_its_run(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    events = spark.createDataFrame([(1,)], "event long")
    monkeypatch.setattr(runs, "_line", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        runs.write_run(root, "r1", {"events": events})
    monkeypatch.undo()
    assert runs.runs(spark, root).count() == 0
    assert runs.write_run(root, "r1", {"events": events}) and runs.read_table(spark, root, "events").count() == 1


def test_outcome_classes(spark):
    results = spark.createDataFrame([(1, 0.5), (2, -1.0)], "event long, r double")
    classes = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x")], "event long, class string")
    got = sorted((r["event"], r["class"], r["n_classes"], r["share"]) for r in runs.outcome_classes(results, classes).collect())
    assert got == [(1, "x", 2, 0.5), (1, "y", 2, 0.5), (2, "x", 1, 1.0)]


def test_register_is_append_only(spark, tmp_path):
    root = str(tmp_path / "register")
    a = runs.register(spark, root, {"title": "t", "verdict": "rejected", "n": 3})
    assert runs.register(spark, root, {"n": 3, "verdict": "rejected", "title": "t"}) == a
    b = runs.register(spark, root, {"title": "t", "verdict": "accepted", "n": 3})
    assert a != b and {r.id: r.verdict for r in runs.registered(spark, root).collect()} == {a: "rejected", b: "accepted"}


def test_exports_read_back_equal(spark, tmp_path):
    schema = "id long, ts timestamp_ntz, x double, text string, ok boolean"
    rows = [(2, dt.datetime(2024, 1, 2, 3, 4, 5, 678901), 0.1, 'a "b", c\n', True), (1, None, None, None, None), (3, dt.datetime(2024, 1, 1), -1e-300, "", False)]
    runs.export_csv(spark.createDataFrame(rows, schema), str(tmp_path / "out"), ["id"])
    got = [tuple(r) for r in runs.import_csv(spark, str(tmp_path / "out"), schema).orderBy("id").collect()]
    want = sorted(rows)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] or "" for r in got] == [r[3] or "" for r in want]


def test_contract_names(spark):
    names = {
        "XYZ SEP19": ("XYZ", 2019, 9), "XYZ_SEP19_minute.txt": ("XYZ", 2019, 9), "XYZSEP2021": ("XYZ", 2021, 9), "es-dec24.Last.txt": ("ES", 2024, 12), "XYZ 09-26": ("XYZ", 2026, 9), "XYZ_12-25.Last.gz": ("XYZ", 2025, 12),
        "XYZ 0926": None, "XYZ 13-26": None, "SEP19": None, "": None, "nothing": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("c", store.contract(F.col("name")))
    assert {r.name: tuple(r.c) if r.c else None for r in df.collect()} == names


def test_front_contract_of_overlapping_files(spark):
    day = lambda d: dt.date(2024, 3, d)
    days = [("X", 2024, 3, day(d), 900) for d in range(1, 12)] + [("X", 2024, 6, day(5), 40)] + [("X", 2024, 6, day(d), 900) for d in range(8, 20)] + [("X", 2024, 9, day(6), 900)] + [("Y", 2024, 6, day(2), 900)]
    spans = contracts.front_spans(spark.createDataFrame(days, "root string, year int, month int, day date, n_bytes long"))
    got = {(r.root, r.month): (r.start.day, r.end and r.end.day) for r in spans.collect()}
    assert got == {("X", 3): (1, 6), ("X", 9): (6, None), ("Y", 6): (2, None)}  # the June contract begins after the September one
    bars = spark.createDataFrame([("X", 2024, m, dt.datetime(2024, 3, d, 12)) for m in (3, 6, 9) for d in range(4, 9)], "root string, year int, month int, ts timestamp_ntz")
    front = contracts.front_bars(bars, spans)
    assert sorted((r.ts.day, r.month, r.seam) for r in front.collect()) == [(4, 3, False), (5, 3, False), (6, 9, True), (7, 9, False), (8, 9, False)]
    assert sorted(r.ts.day for r in contracts.near_seam(front, 1).filter("near_seam").collect()) == [5, 6, 7]


def test_a_vintage_is_stored_once(spark):
    schema = "id long, series string, available_at date, value double"
    have = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), 1.0)], schema)
    new = spark.createDataFrame([(2, "a", dt.date(2024, 1, 1), 9.0), (3, "a", dt.date(2024, 2, 1), 2.0), (4, "a", dt.date(2024, 2, 1), 3.0), (5, "b", dt.date(2024, 1, 1), 4.0)], schema)
    fresh = research.appended_vintages(have, new, ["series"], "available_at")
    assert sorted(r.id for r in fresh.collect()) == [3, 5]
    assert research.appended_vintages(have.unionByName(fresh), new, ["series"], "available_at").count() == 0


def test_csv_files_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,Open,High,Low,Last\n2024-01-01 10:00:00,1,1,1,1\n2024-01-01 10:00:00,2,2,2,2\n")
    (tmp_path / "b.csv").write_text("Time,Open,High,Low,Last\n2024-01-01 10:00:00,3,3,3,3\n" + "2024-01-01 11:00:00,4,4,4,4\n" * 2000 + "2024-01-01 11:00:00,5,5,5,5\nnever,1,1,1,1\n")
    bars, bad = read_csv_bars(spark, str(tmp_path / "*.csv"), "X")
    assert sorted((r.ts.hour, r.close) for r in bars.collect()) == [(10, 3.0), (11, 5.0)] and bad.count() == 1
    (tmp_path / "c.txt").write_text("ts,open,high,low,close,last\n2024-01-01 10:00:00,1,1,1,7,9\n")
    assert read_csv_bars(spark, str(tmp_path / "c.txt"), "X")[0].collect()[0].close == 7.0


def test_late_ticks_are_kept_aside(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "event_type string, ts timestamp, event_id long, value double"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [
        [("a", at(1, 5), 1, 10.0), ("a", at(1, 50), 2, 12.0), ("b", at(1, 1), 3, 5.0), ("a", at(2, 10), 4, 11.0)],
        [("a", at(4, 30), 5, 9.0), ("a", at(1, 30), 6, 20.0), ("b", at(1, 2), 7, 6.0)],  # a's first bar is still open
        [("a", at(1, 40), 8, 99.0), ("a", at(2, 0), 9, 8.0), ("a", at(8, 0), 10, 7.0), ("b", at(0, 0), 11, 4.0), ("b", at(9, 0), 12, 3.0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ticks = st.tick_stream(spark, str(tmp_path / "in"), schema)
        st.write_bars_and_late(st.bars_and_late(ticks), str(tmp_path / "bars"), str(tmp_path / "late"), str(tmp_path / "c")).awaitTermination()
    bars = {(r.instrument, r.ts.hour): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    late = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "late")).collect())
    assert bars == {("a", 2): (10.0, 20.0, 10.0, 12.0, 3), ("a", 3): (8.0, 11.0, 8.0, 11.0, 2), ("a", 5): (9.0, 9.0, 9.0, 9.0, 1), ("b", 1): (4.0, 4.0, 4.0, 4.0, 1), ("b", 2): (5.0, 6.0, 5.0, 6.0, 2)}
    assert late == [8]
    assert sum(v[-1] for v in bars.values()) + len(late) + 2 == sum(map(len, batches))  # two bars are open


def test_cost_profiles():
    known = costs.CostProfile("x", 1.0, 1.0, "a statement", False, broker=0.6, exchange=0.4)
    assert known.round_turn == 2.0 and known.parts() == {"broker": 0.6, "exchange": 0.4}
    assert costs.PROFILES[1].round_turn_points(0.25, 2.0) == pytest.approx(1.45)
    for bad in ({"per_side": -1.0}, {"slippage_ticks": -1.0}, {"source": " "}, {"broker": 0.5}):
        with pytest.raises(ValueError):
            costs.CostProfile(**({"name": "y", "per_side": 1.0, "slippage_ticks": 0.0, "source": "s"} | bad))


def test_profile_table(spark):
    rows = {r.profile: (r.assumed, r.parts_known) for r in costs.profile_table(spark).collect()}
    assert rows == {"none": (True, False), "statement": (False, False), "assumed_parts": (True, True)}


def test_research_run_is_registered_once(spark, tmp_path):
    bars = spark.createDataFrame([("a", k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), 100.0 + k, 101.0 + k, 99.0 + k, 100.5 + k, 1.0) for k in range(200)], "instrument string, i long, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    entries = spark.createDataFrame([("a", k, "up", 1, None, None) for k in range(0, 195, 2)] + [("a", k, "few", -1, 200.0, 0.0) for k in (3, 7)] + [("a", 10, "edges", 1, 100.0, 112.0), ("a", 20, "edges", -1, 122.0, 90.0)], "instrument string, i long, strategy string, direction long, stop double, target double")
    trades = {(r.strategy, r.i): (r.exit_i, r.ended, r.points) for r in research_run.measured(entries, bars, 5).collect()}
    assert trades["up", 0] == (5, "time", 4.5) and trades["edges", 10] == (11, "target", 1.0) and trades["edges", 20] == (21, "stop", -1.0) and ("up", 194) in trades
    root = str(tmp_path / "register")
    first = research_run.research_run(entries, bars, root, "v1", 5).collect()
    assert {r.strategy: r.verdict for r in first} == {"up": "undecided", "few": "undecided", "edges": "undecided"}  # the rising series has no spread
    assert research_run.research_run(entries, bars, root, "v1", 5).collect() == first and runs.registered(spark, root).count() == 3
    other = research_run.research_run(entries, bars.withColumn("volume", F.lit(2.0)), root, "v1", 5).collect()
    assert runs.registered(spark, root).count() == 6 and {r.id for r in other}.isdisjoint({r.id for r in first})
