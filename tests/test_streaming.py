"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from barspark.sources.bars import ticks, ticks_to_bars
from barspark.streaming import bars as st

DATA = "/root/testdata/sf0.001"


def _folder(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), rows.schema


def test_bars(spark, tmp_path):
    folder, schema = _folder(spark, tmp_path)
    got = st.drained(st.bar_stream(st.tick_stream(spark, folder, schema), delay="100 days"), "bars_out", str(tmp_path / "c"), "append").count()
    full = spark.read.parquet(folder)
    complete = st.drained(st.tick_stream(spark, folder, schema).groupBy("instrument").count(), "counts_out", str(tmp_path / "c2"), "complete")
    assert sum(r["count"] for r in complete.collect()) == full.count()
    assert got == 0  # nothing is final before the watermark has passed
    closed = st.drained(st.bar_stream(st.tick_stream(spark, folder, schema), delay="1 minute"), "closed_out", str(tmp_path / "c3"), "append")
    batch = {(r.instrument, str(r.ts)): r.close for r in ticks_to_bars(ticks(spark, DATA), "1 hour").collect()}
    rows = closed.collect()
    assert rows and all(batch[r.instrument, str(r.ts)] == r.close for r in rows)


def test_upsert(spark, tmp_path):
    folder, schema = _folder(spark, tmp_path)
    query = st.upsert_stream(st.tick_stream(spark, folder, schema), str(tmp_path / "t"), ["instrument"], "ts", str(tmp_path / "c"))
    query.awaitTermination()
    stored = {r.instrument: r.event_id for r in st.latest(spark, str(tmp_path / "t")).collect()}
    newest = {}
    for r in ticks(spark, DATA).orderBy("ts").collect():
        newest[r.instrument] = r.event_id
    assert stored == newest


def test_upsert_in_batches(spark, tmp_path):
    rows = ticks(spark, DATA).select("instrument", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price")
    target = str(tmp_path / "t")
    for k, part in enumerate((rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 = 1"), rows.filter("event_id % 3 = 1"), rows.filter("event_id % 3 = 2"))):
        part.repartition(1).write.parquet(str(tmp_path / f"in{k}"))
        spark.read.parquet(str(tmp_path / f"in{k}")).write.mode("append").parquet(str(tmp_path / "in"))
        st.upsert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), target, ["instrument", "event_id"], "ts", str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, st.latest(spark, target).select("instrument", "event_id").collect())) == sorted(map(tuple, rows.select("instrument", "event_id").collect()))


def test_extremes(spark, tmp_path):
    folder, schema = _folder(spark, tmp_path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = st.drained(st.extremes_stream(st.tick_stream(spark, folder, schema)), "extremes_out", str(tmp_path / "c"), "update")
    last = {r.instrument: (r.h, r.l) for r in got.groupBy("instrument").agg(F.max("high").alias("h"), F.min("low").alias("l")).collect()}
    assert last == {r.instrument: (r.h, r.l) for r in ticks(spark, DATA).groupBy("instrument").agg(F.max("price").alias("h"), F.min("price").alias("l")).collect()}


def test_csv_and_vendor_lines(spark, tmp_path):
    from barspark.sources.bars import newest, numbered, read_csv_bars, read_vendor_export

    (tmp_path / "a.csv").write_text("Time,O,H,L,C\n2024-01-01 10:00:00,1,2,0.5,1.5\n2024-01-01 10:00:00,1,3,0.5,2.5\nbad,1,1,1,1\n2024-01-01 11:00:00,2,3,1,2\n")
    bars, bad = read_csv_bars(spark, str(tmp_path / "a.csv"), "X")
    assert [(r.close, r.volume) for r in bars.orderBy("ts").collect()] == [(2.5, 0.0), (2.0, 0.0)] and bad.count() == 1
    assert newest(numbered(bars), 1).first().i == 1
    (tmp_path / "b.txt").write_text("20240101 093000;1;2;0.5;1.5;7\nnonsense\n20240101 093100,1,2,0.5,1.6,8\n")
    good, rest = read_vendor_export(spark, str(tmp_path / "b.txt"), "X", "America/New_York")
    rows = good.orderBy("ts").collect()
    assert [str(r.ts) for r in rows] == ["2024-01-01 14:30:00", "2024-01-01 14:31:00"] and rows[1].volume == 8 and rest.count() == 1
