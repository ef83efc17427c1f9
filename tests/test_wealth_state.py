"""Wealth kept from balance changes equals a full recomputation after every batch, and no range outgrows its bound."""

import random
from itertools import accumulate
from types import SimpleNamespace

import pytest

from ledgerloom.operators import wealth as V
from ledgerloom.plans import catalog_live
from ledgerloom.streaming.wealth_state import WealthState


def same(spark, made, balances, bound):
    rows = [(a, x) for a, x in balances.items()]
    t = spark.createDataFrame(rows or [("none", 0)], "address string, balance long")
    assert made.totals() == (sum(x > 0 for x in balances.values()), sum(x for x in balances.values() if x > 0))
    assert made.gini() == V.gini(t).first()[0] and made.nakamoto() == V.nakamoto(t).first()[0]
    want = sorted((-x, a) for a, x in balances.items() if x > 0)[:25]
    assert [(r.rank, r.address, r.balance) for r in made.rich_list(25).orderBy("rank").collect()] == [(k + 1, a, -x) for k, (x, a) in enumerate(want)]
    assert all(0 < r.rows <= bound for r in made.ranges())


def test_many_batches(spark, tmp_path):
    """Many equal balances, holders that empty and come back, negative ones, a batch that moves everyone, and a rewind."""
    rng, bound, balances, history = random.Random(11), 40, {}, {}
    made = WealthState(spark, str(tmp_path), bound, rows_a_bucket=60)
    for k in range(6):
        names = [f"a{rng.randrange(300)}" for _ in range(200 if k in (0, 3) else 12)]
        deltas = [(a, rng.choice([5, 5, 5, 1, 100, 7000, -5, -balances.get(a, 0), 1 << 50])) for a in dict.fromkeys(names)]
        if k == 2:
            deltas = [("whale", 1 << 61), ("poor", -50), ("a0", 0)]
        made.apply(spark.createDataFrame([*deltas, ("twice", 3), ("twice", -2)], "address string, delta long"), 10 * k, 10 * k + 9)
        for a, x in [*deltas, ("twice", 1)]:
            balances[a] = balances.get(a, 0) + x
        history[k] = dict(balances)
        same(spark, made, balances, bound)
    assert len(made.ranges()) > 4
    made.apply(spark.createDataFrame([("whale", 1)], "address string, delta long"), 0, 30)  # applied already
    with pytest.raises(ValueError):
        made.apply(spark.createDataFrame([("whale", 1)], "address string, delta long"), 55, 70)
    made.rewind(29)
    assert made.store.read().watermark == 29
    same(spark, made, history[2], bound)
    made.forget(19)
    made.apply(spark.createDataFrame([("a1", 77)], "address string, delta long"), 30, 31)
    same(spark, made, history[2] | {"a1": history[2].get("a1", 0) + 77}, bound)


def test_a_small_batch_rewrites_few_ranges(spark, tmp_path):
    made = WealthState(spark, str(tmp_path), 50, rows_a_bucket=50)
    made.apply(spark.createDataFrame([(f"a{k}", k * k + 1) for k in range(1000)], "address string, delta long"), 0, 0)
    before = {r.path for r in made.ranges()}
    made.apply(spark.createDataFrame([("a500", 3)], "address string, delta long"), 1, 1)
    after = {r.path for r in made.ranges()}
    assert len(before) >= 20 and len(after - before) <= 2 and len(after & before) >= len(before) - 2
    made.store.vacuum(keep=1)
    assert made.rows(made.ranges()).count() == 1000


def test_nobody(spark, tmp_path):
    made = WealthState(spark, str(tmp_path))
    assert made.totals() == (0, 0) and made.gini() == 0.0 and made.nakamoto() == 0 and made.rich_list().count() == 0
    made.apply(spark.createDataFrame([("a", 5)], "address string, delta long"), 0, 0)
    made.apply(spark.createDataFrame([("a", -5)], "address string, delta long"), 1, 1)
    assert made.totals() == (0, 0) and made.nakamoto() == 0 and made.ranges() == []
    made.apply(spark.createDataFrame([("b", 4)], "address string, delta long"), 2, 2)
    assert made.totals() == (1, 4) and made.nakamoto() == 1


def test_totals_beyond_64_bits(spark, tmp_path, monkeypatch):
    """Ranges above the one that holds the answer, and all of them together, are worth more than 64 bits hold."""
    made, balances = WealthState(spark, str(tmp_path), 4), {f"a{k:02}": (1 << 62) + k for k in range(20)} | {"poor": 7}
    made.apply(spark.createDataFrame(list(balances.items()), "address string, delta long"), 0, 0)
    assert len(made.ranges()) > 4
    total, sums = sum(balances.values()), list(accumulate(sorted(balances.values(), reverse=True)))
    most = 1 + sum(2 * s <= total for s in sums)
    assert made.totals() == (21, total) and made.nakamoto() == most and made.gini() == round(1 / 21, 6)
    monkeypatch.setattr(catalog_live, "wealth_of", lambda L: made)
    got = catalog_live.live_wealth(SimpleNamespace(spark=spark))
    assert dict(got.dtypes)["total"] == "decimal(38,0)"
    assert [tuple(r) for r in got.collect()] == [(21, total, round(1 / 21, 6), most)]


def test_many_ranges_are_one_scan(spark, tmp_path, monkeypatch):
    """A batch that enters every one of many ranges, many of equal balances, reads them together: a plan of bounded size."""
    made, reads = WealthState(spark, str(tmp_path), 4), []
    balances = {f"a{k:04}": 1 + k // 40 for k in range(400)}
    made.apply(spark.createDataFrame(list(balances.items()), "address string, delta long"), 0, 0)
    n = len(made.ranges())
    assert n >= 100
    whole = type(made.store).rows_of
    monkeypatch.setattr(type(made.store), "rows_of", lambda self, runs, schema: reads.append(len(runs)) or whole(self, runs, schema))
    more = {f"a{k:04}x": 1 + k // 40 for k in range(400)}
    made.apply(spark.createDataFrame(list(more.items()), "address string, delta long"), 1, 1)
    assert len(reads) == 1 and reads[0] > n // 2
    monkeypatch.undo()
    same(spark, made, balances | more, 4)
