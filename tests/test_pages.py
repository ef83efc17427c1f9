"""Pages, searches, coin sets and allocations by hand, with nulls, empty tables and ties."""

from pyspark.sql import functions as F

from ledgerloom.operators import governance as G
from ledgerloom.operators import pages as P


def test_attribution(spark):
    pay, cold, data = "76A914" + "00" * 20 + "88AC", "76A97B63D114" + "00" * 20 + "6714" + "00" * 20 + "6888AC", "6A00"
    cases = [
        (None, 5, pay, (0, None, None)), ([], 5, pay, (0, None, None)), (["x", "CoinStakeTx"], 5, cold, (0, None, None)), (["x"], 0, data, (0, None, None)), (["x"], 0, None, (0, None, None)),
        (["x"], 7, data, (1, "x", None)), (["x"], 7, None, (1, "x", None)), (["x", "y"], 7, cold, (2, "x", "y")), (["x", "y"], 7, pay, (0, None, None)), (["x"], 7, cold, (1, "x", None)),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, a array<string>, v long, s string")
    got = df.select("i", P.attribution(F.col("a"), F.col("v"), F.col("s")).alias("r")).select("i", "r.*").collect()
    assert {r.i: (r.kind, r.addr_a, r.addr_b) for r in got} == {i: c[3] for i, c in enumerate(cases)}


def test_coin_set(spark):
    rows = [(["x"], 10, False, 5, ""), (["x"], 7, True, 95, ""), (["x", "Nonstandard"], 1, False, 5, ""), ([], 3, True, 5, "AABBCCDDEEFF00"), ([], 2, False, 5, "AABBCCDDEEFF11"), (["y"], 0, False, 5, "")]
    coins = spark.createDataFrame(rows, "addresses array<string>, value long, is_coinbase boolean, height long, script string")
    got = lambda **o: {r.address: (r.balance, r.coinbase_balance) for r in P.coin_set(coins, **o).collect()}
    assert got() == {"x": (18, 7), "UNKNOWN_COINBASE_aabbccddeeff": (0, 3)}
    assert got(maturity=100, tip=150)["x"] == (11, 7) and got(maturity=100, tip=195)["x"] == (18, 7) and got(coinbase=False)["x"] == (11, 7)
    assert got(unknown=True, shielded=True)["UNKNOWN_aabbccddeeff"] == (5, 0) and got(shielded=True)["SHIELDED_UNKNOWN"] == (5, 3)
    assert P.coin_set(coins.limit(0)).count() == 0


def test_search(spark):
    block = spark.createDataFrame([(3,)], "height long")
    chain = spark.createDataFrame([("B3", 3), ("X3", 3), ("B3", 3)], "block_hash string, true_height long")
    tx = spark.createDataFrame([(3, 3)], "txid long, height long")
    totals, account = spark.createDataFrame([("D1",), ("3",)], "address string"), spark.createDataFrame([(2,), (2,)], "account long")
    asked = spark.createDataFrame([(" 3",), ("X3",), ("T3",), ("D1",), ("xpub2",), ("D2",), ("",), (None,), ("T3",)], "q string")
    got = sorted((str(r.q), r.found, r.height) for r in P.search(asked, block, chain, tx, totals, account).collect())
    want = [(" 3", "block", 3), ("X3", "block", 3), ("T3", "tx", 3), ("T3", "tx", 3), ("D1", "address", None), ("xpub2", "account", None), ("D2", "not-found", None), ("", "not-found", None), ("None", "not-found", None)]
    assert got == sorted(want)


def test_allocation(spark):
    """Ties go by id, a later smaller one may still fit, nulls and negative amounts count as 0, far-apart ids keep their order."""
    rows = [(1, 1 << 20, 9, 60, True), (1, 5, 9, 50, True), (1, 7, 8, 30, True), (1, 8, 7, 20, True), (1, 9, 6, None, True), (1, 10, 5, -4, True), (1, 11, 4, 1, False), (1, 12, 3, 1, None), (2, 5, 1, 200, True), (3, 1, 1, 1, False)]
    p = spark.createDataFrame(rows, "cycle int, proposal_id long, net int, amount long, eligible boolean")
    got = {(r.cycle, r.proposal_id): (r.outcome, r.spent_before) for r in G.allocate(p, 100).collect()}
    assert got == {
        (1, 5): ("funded", 0), (1, 1 << 20): ("cut", 50), (1, 7): ("funded", 50), (1, 8): ("funded", 80), (1, 9): ("funded", 100), (1, 10): ("funded", 100),
        (1, 11): ("belowgate", 100), (1, 12): ("belowgate", 100), (2, 5): ("cut", 0), (3, 1): ("belowgate", 0),
    }
    assert G.allocate(p.limit(0), 100).count() == 0
    none = p.where("cycle = 2")
    assert [(r.outcome, r.spent_before) for r in G.allocate(none, 100).collect()] == [("cut", 0)]
