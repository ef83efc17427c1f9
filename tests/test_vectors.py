"""Small literal inputs with known results."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import address as A
from ledgerloom.operators import chain as H
from ledgerloom.operators import daily as D
from ledgerloom.operators import wealth as V

COIN = 100_000_000


def balances(spark, *rows):
    return spark.createDataFrame(list(rows), "address string, balance long")


def test_equal_balances_rank_in_address_order(spark):
    """Twelve holders on three levels of balance, given in descending order: within a level the address decides."""
    names = [f"h{k:02}" for k in range(12)]
    held = [(n, 7 * (1 + k % 3)) for k, n in enumerate(names)]
    want = [n for level in (21, 14, 7) for n, b in held if b == level]
    assert [r.address for r in V.rich_list(balances(spark, *reversed(held))).orderBy("rank").collect()] == want
    assert [r.address for r in V.rich_list(balances(spark, *held), 5).orderBy("rank").collect()] == want[:5]


def test_sums_beyond_64_bits_of_intermediate_terms(spark):
    """Three balances near the largest that a column holds: the rank sum needs more than 64 bits, the total does not."""
    third = (1 << 63) // 3
    t = balances(spark, ("p", third), ("q", third - 7), ("r", third - 11))
    assert V.top_shares(t).first().total == 3 * third - 18
    assert V.nakamoto(t).first()[0] == 2 and V.gini(t).first()[0] == 0.0


def test_exactly_half_is_not_more_than_half(spark):
    """The largest holder has exactly half of all: one more holder is needed; one coin more, and it is enough."""
    rest = [(f"h{k}", 4) for k in range(9)]
    assert V.nakamoto(balances(spark, ("big", 36), *rest)).first()[0] == 2
    assert V.nakamoto(balances(spark, ("big", 37), *rest)).first()[0] == 1
    assert V.nakamoto(balances(spark, *rest)).first()[0] == 5  # nine equal ones


def test_no_holders(spark):
    t = balances(spark, ("a", 0), ("b", -10))
    assert V.gini(t).first()[0] == 0.0 and V.nakamoto(t).first()[0] == 0 and V.top_shares(t).first().holders == 0
    assert [r.n for r in V.histogram(t).collect()] == [0] * 7


def test_histogram_at_the_bounds_of_its_ranges(spark):
    """A balance exactly at a range's lower bound belongs to it, one unit less to the range below; the top range is open."""
    edges = [10**k * COIN for k in range(6)]
    t = balances(spark, *((f"at{k}", x) for k, x in enumerate(edges)), *((f"under{k}", x - 1) for k, x in enumerate(edges)), ("top", 90_000_000 * COIN), ("one", 1))
    assert [r.n for r in V.histogram(t).orderBy("lo_coins").collect()] == [2, 2, 2, 2, 2, 2, 2]


@pytest.mark.parametrize(
    "height,coins", [(0, 250), (1, 60001), (2, 250), (86_400, 250), (86_401, 225), (151_201, 45), (302_401, 40.5), (604_800, 13.5), (648_001, 4.5), (1_153_160, 4.5), (1_153_161, 5), (3_715_200, 5), (3_715_201, 10)]
)
def test_block_reward(spark, height, coins):
    r = S.with_era(spark.createDataFrame([(height,)], "era_height long")).collect()
    assert len(r) == 1 and r[0].era_reward == coins * COIN


@pytest.mark.parametrize("height,coins", [(259_200, 0), (259_201, 22.5), (1_153_161, 2), (3_715_200, 2), (3_715_201, 4)])
def test_staker_share(spark, height, coins):
    assert S.with_era(spark.createDataFrame([(height,)], "era_height long")).first().era_staker == coins * COIN


def joined_row(spark, **x):
    base = dict(height=4_000_000, ty=0, out_sum=0, value_balance=0, n_outputs=2, in_sum=0, with_prevout=1, resolved=1, era_reward=10 * COIN, era_staker=4 * COIN) | x
    return spark.createDataFrame([base]).withColumns(D.join_arithmetic()).first()


def test_fee_rules(spark):
    assert joined_row(spark, in_sum=10 * COIN, out_sum=9 * COIN).fee == COIN
    assert joined_row(spark, in_sum=10 * COIN, out_sum=9 * COIN, with_prevout=2).fee == 0
    assert joined_row(spark, in_sum=9 * COIN, out_sum=10 * COIN).fee == 0
    assert joined_row(spark, in_sum=1000 * COIN, out_sum=0).fee == 0


def test_stake_rewards(spark):
    small = joined_row(spark, ty=1, in_sum=100 * COIN, out_sum=150 * COIN)
    assert (small.rewards, small.staker_rewards, small.treasury) == (50 * COIN, 4 * COIN, 0)
    big = joined_row(spark, ty=1, in_sum=100 * COIN, out_sum=5110 * COIN)
    assert (big.rewards, big.treasury) == (10 * COIN, 5000 * COIN)
    assert joined_row(spark, ty=1, in_sum=0, out_sum=50 * COIN, resolved=0).rewards == 0


def test_balance_history(spark):
    f = spark.createDataFrame([("a", "t1", 10, 100, 0), ("a", "t2", 20, 50, 0), ("a", "t3", 30, 39, 100)], "address string, txid string, height long, received long, spent long")
    b = spark.createDataFrame([(10, 100), (20, 100), (30, 3700)], "height long, ntime long")
    rows = {r.bucket: (r.txs, r.received, r.sent, r.sent_to_self) for r in A.balance_history(f, b).collect()}
    assert rows == {0: (2, 150, 0, 0), 3600: (1, 39, 100, 39)}
    assert A.balance_curve(A.balance_history(f, b)).orderBy(F.desc("bucket")).first().balance == 89
    with pytest.raises(Exception, match="no time"):
        A.balance_history(f, b.where("height < 30")).collect()


def test_heavier_branch_wins(spark):
    easy, hard = 0x1B0FFFFF, 0x1B00FFFF
    rows = [("g", None, easy), ("a1", "g", easy), ("a2", "a1", easy), ("a3", "a2", easy), ("b1", "g", hard), ("b2", "b1", hard)]
    chain = spark.createDataFrame(rows, "block_hash string, prev_hash string, nbits long")
    worked = H.cumulative_work(chain)
    assert H.best_tip(worked).first().block_hash == "b2"
    assert {(r.height, r.block_hash) for r in H.canonical_chain(worked).collect()} == {(0, "g"), (1, "b1"), (2, "b2")}


def test_work_that_is_not_defined_is_an_error(spark):
    chain = spark.createDataFrame([("g", None, 0x1B0FFFFF), ("a", "g", 0x030FFFFF)], "block_hash string, prev_hash string, nbits long")
    with pytest.raises(Exception, match="no work is defined for the target of block a"):
        H.cumulative_work(chain).collect()


def test_forks_of_long_and_nested_branches(spark):
    """Main chain of 40; a branch of 13, a branch off that branch, two blocks on one parent, and a branch of unknown root."""
    easy = 0x1B0FFFFF
    links = [("m0", None), *((f"m{k}", f"m{k - 1}") for k in range(1, 40)), ("s8", "m7"), *((f"s{k}", f"s{k - 1}") for k in range(9, 21)), ("t12", "s11"), ("t13", "t12"), ("u30", "m29"), ("v30", "m29"), ("z1", "nobody"), ("z2", "z1")]
    chain = spark.createDataFrame([(*x, easy) for x in links], "block_hash string, prev_hash string, nbits long")
    main = H.canonical_chain(H.cumulative_work(chain))
    assert {(r.height, r.block_hash) for r in main.collect()} == {(k, f"m{k}") for k in range(40)}
    got = {(r.tip_hash, r.tip_height, r.fork_hash, r.fork_height, r.depth) for r in H.fork_points(chain, main).collect()}
    assert got == {("s20", 20, "m7", 7, 13), ("t13", 13, "m7", 7, 6), ("u30", 30, "m29", 29, 1), ("v30", 30, "m29", 29, 1)}


def test_work_is_exact(spark):
    rows = [((e << 24) | m,) for e in (20, 27, 29, 34) for m in (1, 0xFFFF, 0x7FFFFF, 12345)]
    for r in spark.createDataFrame(rows, "nbits long").withColumn("w", S.block_work(F.col("nbits"))).collect():
        target = (r.nbits & 0xFFFFFF) << (8 * ((r.nbits >> 24) - 3))
        assert int(r.w) == (1 << 256) // (target + 1)


def test_dated_credits_need_no_join_by_height(spark):
    """First days of credits that carry their date: the same, by one aggregation in memory and without a join."""
    from ledgerloom.operators import daily as D

    block = spark.createDataFrame([(1, "2020-02-01"), (2, "2020-01-31"), (3, "2020-02-02")], "height long, date string")
    credit = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 1), ("c", 3)], "address string, height long")
    dated = D.new_by_day(credit.join(block, "height"), block)
    want = {("2020-01-31", 1), ("2020-02-01", 1), ("2020-02-02", 1)}
    assert {tuple(r) for r in dated.collect()} == want == {tuple(r) for r in D.new_by_day(credit, block).collect()}
    plan = D.new_by_day(spark.range(9).selectExpr("string(id) AS address", "'2020-01-01' AS date"), block)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan
