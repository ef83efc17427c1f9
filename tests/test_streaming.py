"""Streams of samples and metrics, comparisons, exports; the live lane has tests of its own."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import catalog
from ledgerloom.sources import io
from ledgerloom.sources.ledger import Ledger
from ledgerloom.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ledger(spark):
    return Ledger(spark, SF, keep=True)


def test_shadow_diff_finds_changes(spark):
    a = spark.createDataFrame([("d1", 1, 2), ("d2", 3, 4)], "date string, x long, y long")
    b = spark.createDataFrame([("d1", 1, 5), ("d3", 3, 4)], "date string, x long, y long")
    assert {(r.date, r.field) for r in live.shadow_diff(a, b, ("x", "y")).collect()} == {("d1", "y"), ("d2", "x"), ("d2", "y"), ("d3", "x"), ("d3", "y")}


def test_hourly_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "value")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = live.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("hours").collect()) == sorted(live.hourly(events).collect())


def test_exports(spark, ledger, tmp_path):
    days = catalog.daily(ledger)
    io.write_daily(days, f"{tmp_path}/d")
    some = days.orderBy("date").limit(1)
    io.write_daily(some.withColumn("tx_count", F.lit(-1).cast("long")), f"{tmp_path}/d")
    back = spark.read.parquet(f"{tmp_path}/d")
    assert back.count() == days.count() and back.where("tx_count = -1").count() == 1
    io.export_txids(ledger.tx, f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").count() == ledger.tx.count()
    io.export_csv(days.select("date", "tx_count"), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == days.count()
    got = io.json_fields(spark.createDataFrame([('{"a": 5}',), ("broken",), (None,)], "j string"), "j", {"a": "long", "b": "double"}).select("a", "b").collect()
    assert [tuple(r) for r in got] == [(5, 0.0), (0, 0.0), (0, 0.0)]


def test_event_sink(spark, ledger, tmp_path):
    ledger.block.select("height", "ntime").coalesce(1).write.parquet(f"{tmp_path}/b")
    stream = spark.readStream.schema("height long, ntime long").parquet(f"{tmp_path}/b").select(F.lit("block").alias("kind"), F.col("height").cast("string").alias("id"))
    io.write_events(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == ledger.block.count()


def test_levels_and_stalls(spark):
    """By hand: a level must hold at each evaluation; a stall may cross days; a broken run starts anew."""
    levels = spark.createDataFrame([("a", t) for t in (0, 30, 60, 120, 150, 180)], "event_type string, start long")
    assert {(r.event_type, r["at"]) for r in live.held_for(levels, 60).collect()} == {("a", 60), ("a", 180)}
    rows = [("a", "1970-01-01 23:58:00"), ("a", "1970-01-02 00:10:00"), ("a", "1970-01-02 00:11:00"), ("b", "1970-01-02 00:00:00"), ("b", None)]
    metrics = spark.createDataFrame(rows, "event_type string, ts string")
    assert [tuple(r) for r in live.stalls(metrics, 600).collect()] == [("a", 86280, 87000)]
    seen = spark.createDataFrame([(1, 0), (1, 3600), (1, 10800), (2, 3600)], "k int, hour long")
    assert {tuple(r) for r in live.first_seen(seen, "k").collect()} == {(1, 0, 0), (1, 3600, 0), (1, 10800, 10800), (2, 3600, 3600)}
    metrics = spark.createDataFrame([("a", "1970-01-01 00:00:10", v) for v in (0.5, 3.0, 3.0, 3.0, 1000.0, None)], "event_type string, ts string, value double")
    half = {r.p95 for r in live.bucket_quantiles(metrics, 0.5).collect()}
    assert half == {1 + 4 * 1.5 / 3} and {r.p95 for r in live.bucket_quantiles(metrics, 0.95).collect()} == {500.0}
