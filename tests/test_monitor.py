"""Mempool snapshots, the watchdog and alert states: streams against hand-made cases and their batch forms."""

import time
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.streaming import monitor

SF = "/root/testdata/sf0.001"


def snapshots(spark, polls):
    """Rows (txid, at) of {at: ids}; an empty snapshot is one row without an id."""
    return spark.createDataFrame([(x, at) for at, ids in polls.items() for x in (ids or [None])], "txid long, at long")


def plain(polls):
    """(changes, entries) by a loop over snapshots."""
    held, out = {}, Counter()
    for at in sorted(polls):
        for x in [x for x in held if x not in polls[at]]:
            out[at, x, "removed", held.pop(x)] += 1
        for x in set(polls[at]) - set(held):
            held[x] = at
            out[at, x, "added", at] += 1
    return out, held


def test_snapshots_in_any_batches(spark, tmp_path):
    """Entries that stay, leave and come back; an empty snapshot in the middle; uneven times; snapshots given twice."""
    polls = {10: [1, 2, 3], 20: [2, 3], 35: [1, 2, 4], 36: [], 50: [2, 4, 5], 90: [5], 91: [5, 6, 1]}
    for name, cuts in (("one", [91]), ("each", list(polls)), ("some", [20, 36, 50, 91])):
        made = monitor.Mempool(spark, f"{tmp_path}/{name}", most_runs=2)
        for hi in cuts:
            made.apply(snapshots(spark, {at: ids for at, ids in polls.items() if at <= hi}))
        changes, held = plain(polls)
        assert Counter(map(tuple, made.table("changes").collect())) == changes
        assert {r.txid: r.first_seen for r in made.table("entries").collect()} == held
    version = made.store.read().version
    made.apply(snapshots(spark, {35: [9]}))
    assert made.store.read().version == version


def test_a_stream_of_snapshots(spark, tmp_path):
    polls = {k: [x for x in range(30) if (x * 7 + k) % 11 < 5] for k in range(1, 7)}
    for at in polls:
        snapshots(spark, {at: polls[at]}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    made = monitor.Mempool(spark, f"{tmp_path}/mempool")
    stream = spark.readStream.schema("txid long, at long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    made.follow(stream, f"{tmp_path}/ck").awaitTermination()
    changes, held = plain(polls)
    assert Counter(map(tuple, made.table("changes").collect())) == changes and {r.txid for r in made.table("entries").collect()} == set(held)


def started(spark, df, name, path):
    """A started query into a table in memory, and what undoes the setting of its state store."""
    return df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").start()


def wait(spark, q, name, condition, seconds=60):
    for _ in range(seconds * 2):
        if q.exception() or spark.table(name).where(condition).count():
            break
        time.sleep(0.5)
    assert q.exception() is None
    return spark.table(name).where(condition).count()


def test_a_tip_that_stands_still(spark, tmp_path):
    """No block comes and one alarm is given; a block clears it; a block of an old time alarms at once."""
    add = lambda rows: spark.createDataFrame(rows, "chain string, height long, ntime long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    now = int(time.time())
    add([("main", 5, now), ("main", 4, now - 9000), ("other", 9, now + 3600)])
    stream = spark.readStream.schema("chain string, height long, ntime long").parquet(f"{tmp_path}/feed")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    q = started(spark, monitor.watch_tips(stream, limit=4), "tips", tmp_path)
    try:
        assert wait(spark, q, "tips", "state = 'frozen'") == 1
        time.sleep(3)
        assert [tuple(r)[:3] for r in spark.table("tips").collect()] == [("main", 5, "frozen")]
        add([("main", 6, int(time.time()) + 3600)])
        assert wait(spark, q, "tips", "state = 'cleared' AND height = 6") == 1
        add([("main", 6, now), ("main", 7, now - 5000)])
        assert wait(spark, q, "tips", "state = 'frozen' AND height = 7") == 1
    finally:
        q.stop()
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {r.chain for r in spark.table("tips").collect()} == {"main"}
    assert spark.table("tips").where("height = 5").first().age >= 4


def test_states_of_alerts(spark, tmp_path):
    """By hand, across midnight too; the stream says the same as the batch form, whatever the batches."""
    t = 86_400
    holds = {"a": [t - 60, t - 30, t, t + 30, t + 120], "b": [t + 300], "c": [t + 270, t + 300]}
    last = t + 300
    rows = spark.createDataFrame([(r, x) for r, xs in holds.items() for x in [*xs, xs[0]]], "rule string, at long")
    got = {tuple(r) for r in monitor.transitions(rows, 60, spark.createDataFrame([(last,)], "last long")).collect()}
    want = {("a", t - 60, "pending"), ("a", t, "firing"), ("a", t + 60, "resolved"), ("a", t + 120, "pending"), ("a", t + 150, "inactive"), ("b", t + 300, "pending"), ("c", t + 270, "pending")}
    assert got == want
    grid = range(t - 120, last + 30, 30)
    for lo in (0, 4, 9):
        part = [(r, x, x in xs) for r, xs in holds.items() for x in list(grid)[lo : {0: 5, 4: 9, 9: 99}[lo]]]  # the second batch repeats an evaluation
        spark.createDataFrame(part, "rule string, at long, holds boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = spark.readStream.schema("rule string, at long, holds boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    q = monitor.alert_states(stream, 60).writeStream.outputMode("update").format("memory").queryName("alerts").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert Counter(map(tuple, spark.table("alerts").collect())) == Counter(want)


def test_silence_is_seen_where_there_are_no_rows(spark):
    """Evaluations at which a whole window has no event, between a type's first and last."""
    at = [0, 100, 1000, 1290]
    rows = spark.createDataFrame([("x", x) for x in at], "event_type string, t long").select("event_type", F.timestamp_seconds("t").alias("ts"))
    want = [k for k in range(0, 1290, 30) if 0 < k and not any(k <= x < k + 300 for x in at) and any(x < k for x in at) and any(x >= k + 300 for x in at)]
    assert sorted(r["at"] for r in monitor.silences(rows).collect()) == want
