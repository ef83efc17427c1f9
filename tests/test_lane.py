"""The live lane over its own state: batches of any cut equal batch, reads are pruned, rewinds and crashes leave no trace."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import daily as D
from ledgerloom.operators import joins as J
from ledgerloom.plans import catalog
from ledgerloom.sources.ledger import Ledger
from ledgerloom.streaming import lane, live, store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ledger(spark):
    return Ledger(spark, SF, keep=True)


@pytest.fixture(scope="module")
def feed(ledger):
    return lane.feed(ledger.tx, ledger.inp, ledger.out).persist()


@pytest.fixture(scope="module")
def batch(ledger):
    return catalog.daily(ledger).where("tx_count > 0").persist()


def same(made, batch, ledger):
    made.recompute(ledger.block, ledger.chain)
    assert live.shadow_diff(made.series(), batch, live.ADDITIVE + live.WINDOWED).count() == 0


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_batches_equal_batch_in_all_columns(spark, ledger, feed, batch, tmp_path):
    """Cuts within blocks, late, repeated and out-of-order batches; small buckets and merges; then a rewind and a replay."""
    made = lane.Lane(spark, str(tmp_path), 1500, rows_a_bucket=200, most_runs=2)
    bring = lambda c: made.apply(feed.where(c), ledger.block, ledger.chain)
    assert made.watermark() == -1 and made.series().count() == 0
    bring("height < 90 AND (txid + height) % 3 <> 1")
    assert made.watermark() < 89
    bring("height BETWEEN 200 AND 260")
    bring("height < 90")
    assert made.watermark() == 89
    for lo in (80, 230):
        bring(f"height BETWEEN {lo} AND {lo + 155}")
    assert made.watermark() == 374
    assert batch.where("orphan_blocks > 0").count() > 0
    same(made, batch, ledger)
    version = made.store.read().version
    bring("height < 300")
    assert made.store.read().version == version  # replayed rows change nothing
    paid = D.treasury_payouts(catalog.ptx(ledger), ledger.block)
    assert rows(made.table("treasury")) == rows(paid)
    assert made.rewind(300, ledger.block) and made.watermark() <= 300
    assert made.table("treasury").where(F.col("height") > made.watermark()).count() == 0
    assert made.table("outpoints").where(F.col("height") > made.watermark()).count() == 0
    bring("height > 0")
    same(made, batch, ledger)
    assert rows(made.table("treasury")) == rows(paid)
    assert made.table("outpoints").count() == ledger.out.count()


def test_a_stream_of_blocks(spark, ledger, feed, batch, tmp_path):
    for lo in range(0, 375, 125):
        feed.where(F.col("height").between(lo, lo + 124)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    made = lane.Lane(spark, f"{tmp_path}/lane", 1500)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    made.follow(stream, ledger.block, ledger.chain, f"{tmp_path}/ckpt").awaitTermination()
    same(made, batch, ledger)


def test_a_batch_reads_only_the_buckets_it_names(spark, ledger, feed, tmp_path):
    made = lane.Lane(spark, str(tmp_path), 1500, rows_a_bucket=20)
    made.apply(feed.where("height < 300"), ledger.block, ledger.chain)
    runs = made.store.read().runs("outpoints")
    files = len(made.outpoints.lookup(runs, feed.select("txid")).inputFiles())
    keys = feed.where("height = 300").select(F.inline("ins")).select(F.col("prev_txid").alias("txid"))
    some = made.outpoints.lookup(runs, keys)
    assert 0 < len(some.inputFiles()) <= 4 * keys.distinct().count() < files / 2
    one = feed.where("height = 300").select("txid", F.inline("ins"))
    got = made.outpoints.resolve(runs, one, made.table("outpoints").where("false"))
    want = J.prevout_join(one, ledger.out, ledger.tx.where("height < 300"))
    assert rows(got) == rows(want) and got.where("value IS NOT NULL").count() > 0
    paid = catalog.credit(ledger).where("height = 300").select("address")
    seen = made.store.read().runs("seen")
    assert len(made.seen.days(seen, paid).inputFiles()) < sum(r.buckets - len(r.empty) for r in seen) / 2


def test_new_branch_replaces_the_old_one(spark, ledger, feed, tmp_path):
    """After a fork the new branch has other transactions at the same heights, and fewer of them: nothing of the old stays."""
    made = lane.Lane(spark, str(tmp_path), 1500, rows_a_bucket=50)
    made.apply(feed.where("height < 200"), ledger.block.where("height < 200"), ledger.chain)
    new = feed.where("height <= 150 OR (height < 190 AND txid % 2 = 0)")
    block = ledger.block.where("height < 190").drop("n_tx").join(new.groupBy("height").agg(F.count("*").alias("n_tx")), "height")
    assert made.rewind(150, ledger.block.where("height <= 150"))
    made.apply(new, block, ledger.chain)
    txs = new.select("txid")
    cut = lambda df: df.join(txs, "txid", "left_semi")
    tx, out, inp = cut(ledger.tx), cut(ledger.out), cut(ledger.inp)
    whole = lane.Lane(spark, f"{tmp_path}/whole", 1500)
    whole.apply(new, block, ledger.chain)
    made.recompute(block, ledger.chain)
    assert rows(made.table("daily").drop("coin_days_destroyed")) == rows(whole.table("daily").drop("coin_days_destroyed"))
    assert rows(made.table("window")) == rows(whole.table("window"))
    assert rows(made.table("treasury")) == rows(whole.table("treasury"))
    days = live.day_deltas(D.per_transaction(tx, out, J.prevout_join(inp, out, tx), 1500), block)
    assert live.shadow_diff(made.table("daily"), days, live.ADDITIVE).count() == 0
    first = D.new_by_day(J.credits(out, tx), block)
    assert rows(made.table("window").where("new_addresses > 0").select("date", "new_addresses")) == rows(first)


def test_a_deep_reorganisation_is_refused_and_a_shallow_one_changes_nothing(spark, ledger, feed, tmp_path):
    made = lane.Lane(spark, str(tmp_path), 1500, max_reorg=100)
    made.apply(feed, ledger.block, ledger.chain)
    version = made.store.read().version
    assert not made.rewind(10, ledger.block) and made.rewind(374, ledger.block) and made.store.read().version == version
    with pytest.raises(ValueError):
        made.rewind(300, ledger.block.where("height < 300"))


def test_a_crash_before_the_commit_is_invisible_and_old_versions_go(spark, ledger, feed, tmp_path, monkeypatch):
    made = lane.Lane(spark, str(tmp_path), 1500)
    made.apply(feed.where("height < 100"), ledger.block, ledger.chain)
    before, files = made.store.read(), made.store.files
    monkeypatch.setattr(made.store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        made.apply(feed.where("height < 200"), ledger.block, ledger.chain)
    with pytest.raises(RuntimeError):
        made.rewind(50, ledger.block)
    monkeypatch.undo()
    assert made.store.read() == before
    left = len(files.names("data"))
    assert made.store.vacuum() > 5 and len(files.names("data")) < left
    for hi in (150, 180):
        made.apply(feed.where(F.col("height") < hi), ledger.block, ledger.chain)
    assert made.store.vacuum(keep=1) >= 2 and len(made.store.versions()) == 1
    whole = lane.Lane(spark, f"{tmp_path}/whole", 1500)
    whole.apply(feed.where("height < 180"), ledger.block, ledger.chain)
    made.recompute(ledger.block, ledger.chain)
    whole.recompute(ledger.block, ledger.chain)
    assert rows(made.series().drop("coin_days_destroyed")) == rows(whole.series().drop("coin_days_destroyed"))
    # A second writer that read the same version comes too late.
    stale = made.store.read()
    made.store.commit(stale, stale.watermark, {})
    with pytest.raises(RuntimeError):
        made.store.commit(stale, stale.watermark, {})


def test_runs_are_cut_and_merged(spark, tmp_path):
    """By hand: rows above a cut are gone from reads and from merges, small runs merge, keys of one bucket come back."""
    s = store.Store(spark, str(tmp_path), rows_a_bucket=10, most_runs=2, sparing=2)
    schema = "k long, height long"
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("id % 7 AS k", "id AS height")
    runs = s.write(make(0, 100), 0, 99, "k")
    assert runs[0].buckets == 16 and runs[0].rows == 100 and len(runs[0].empty) >= 9
    for lo in (100, 110, 120):
        runs = s.merged(runs + s.write(make(lo, lo + 10), lo, lo + 9, "k"), schema, "k")
    assert len(runs) == 2 and [r.rows for r in runs] == [100, 30]
    runs = store.cut(runs, 104)
    assert [(r.lo, r.hi, r.cut) for r in runs] == [(0, 99, False), (100, 104, True)]
    assert rows(s.rows(runs, schema)) == rows(make(0, 105))
    slots = store.slots_of(spark.createDataFrame([(3,)], "k long"), "k")
    assert rows(s.rows(runs, schema, slots).where("k = 3")) == rows(make(0, 105).where("k = 3"))
    merged = s.merged(runs + s.write(make(105, 108), 105, 107, "k"), schema, "k")
    assert rows(s.rows(merged, schema)) == rows(make(0, 108)) and s.write(make(0, 0), 0, 0) == []
    assert s.rows([], schema).count() == 0


def test_first_days_with_clocks_that_run_backwards(spark, tmp_path):
    """An address paid at a greater height on an earlier day is new on that day; a cut brings the later day back."""
    s = store.Store(spark, str(tmp_path))
    seen = lane.FirstSeen(s)
    paid = lambda rows: spark.createDataFrame(rows, "address string, date string, height long")
    runs = seen.add([], paid([("a", "d5", 1), ("a", "d4", 3), ("a", "d6", 4), ("b", "d5", 2)]), 0, 5, 4)
    runs = seen.add(runs, paid([("b", "d3", 7), ("a", "d7", 8), ("c", "d7", 8)]), 6, 9, 3)
    first = lambda r: {tuple(x) for x in seen.days(r, paid([("a", "", 0), ("b", "", 0), ("c", "", 0)]).select("address")).collect()}
    assert first(runs) == {("a", "d4"), ("b", "d3"), ("c", "d7")}
    assert first(store.cut(runs, 6)) == {("a", "d4"), ("b", "d5")} and first(store.cut(runs, 2)) == {("a", "d5"), ("b", "d5")}


def test_side_blocks_of_the_day_before_a_batch_ends(spark, ledger, feed, tmp_path):
    """A batch ends shortly after midnight, a side block is an hour older, and the next batch begins on a later day."""
    b = {r.height: r for r in ledger.block.where("height < 80").collect()}
    days = {h: int(r.ntime) // 86400 for h, r in b.items()}
    h = next(h for h in range(10, 79) if days[h] == days[h - 1] + 1 and days[h + 1] > days[h])
    late = b[h].ntime - 5000
    assert late // 86400 == days[h] - 1
    side = spark.createDataFrame([("Y", f"B{h - 2}", h - 1, late, b[h].nbits, 1)], "block_hash string, prev_hash string, true_height long, ntime long, nbits long, stale int")
    chain = ledger.chain.unionByName(side)
    made = lane.Lane(spark, str(tmp_path), 1500, every=1)
    made.apply(feed.where(F.col("height") <= h), ledger.block, chain)
    made.apply(feed, ledger.block, chain)
    got = {r.date: r.orphan_blocks for r in made.series().where("orphan_blocks > 0").collect()}
    want = {r.date: r.orphan_blocks for r in D.orphans_by_day(chain, ledger.block, lane.utc_date).collect()}
    assert b[h - 1].date in want and got == {d: n for d, n in want.items() if d in {r.date for r in made.series().select("date").collect()}}
