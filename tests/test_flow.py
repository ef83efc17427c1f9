"""Value flow, recovered inputs and address pages by hand."""

import pytest

from ledgerloom.operators import address as A
from ledgerloom.operators import flow

JOINED = "txid long, prev_txid long, prev_vout int, value long, kind int, addr_a string, addr_b string, prev_height long"
OUT = "txid long, vout int, value long, kind int, addr_a string, addr_b string"
PTX = "txid long, ty int, resolved long, with_prevout long, out_sum long, era_reward long"


@pytest.fixture(scope="module")
def tables(spark):
    joined = [
        (1, 90, 0, 50, 1, "a", None, 3), (1, 91, 2, 30, 1, "a", None, 3), (1, 91, 3, 7, 0, None, None, 3), (1, 92, 0, 5, 2, "s", "o", 3),
        (2, 80, 1, None, None, None, None, None), (3, 80, 2, None, None, None, None, None), (3, 80, 3, None, None, None, None, None),
        (4, 80, 4, None, None, None, None, None), (5, 80, 5, None, None, None, None, None),
    ]
    out = [
        (1, 0, 60, 1, "b", None), (1, 1, 0, 0, None, None), (1, 2, 9, 0, None, None), (1, 3, 4, 2, "s", "o"),
        (2, 0, 0, 0, None, None), (2, 1, 40, 1, "x", None), (2, 2, 70, 2, "s", "o"), (3, 1, 10, 1, "y", None), (4, 1, 10, 1, "z", None), (5, 0, 10, 1, "w", None),
    ]
    tx = spark.createDataFrame([(1, -19), (2, 0), (3, 5), (4, 0), (5, 0)], "txid long, value_balance long")
    ptx = [(1, 0, 4, 4, 73, 20), (2, 1, 0, 1, 110, 20), (3, 1, 0, 2, 10, 2), (4, 1, 0, 1, 10, 20), (5, 0, 0, 1, 10, 2)]
    return spark.createDataFrame(joined, JOINED), spark.createDataFrame(out, OUT), tx, spark.createDataFrame(ptx, PTX)


def test_recovered_inputs(tables):
    """One input gives a value, two don't, a negative one is null; a payment isn't recovered; two addresses go before one."""
    joined, out, _, ptx = tables
    got = {tuple(r) for r in flow.recovered(flow.numbered(joined), out, ptx).collect()}
    assert got == {(2, 0, "s", "o", 90), (3, 0, "y", None, None), (3, 1, "y", None, None), (4, 0, "z", None, None)}


def test_edges(tables):
    got = {tuple(r) for r in flow.edges(*tables).collect()}
    assert got == {
        (1, "in:a", "TX", 80), (1, "coinbase#2", "TX", 7), (1, "in:o", "TX", 5), (1, "TX", "out:b", 60), (1, "TX", "out#2", 9), (1, "TX", "out:o", 4), (1, "TX", "POOL", 19),
        (2, "in:o", "TX", 90), (2, "TX", "out:x", 40), (2, "TX", "out:o", 70), (3, "TX", "out:y", 10), (3, "POOL", "TX", 5), (4, "TX", "out:z", 10), (5, "TX", "out:w", 10),
    }


def test_pages_of_an_address(spark):
    txs = spark.createDataFrame([("a", k, 100 + k // 2) for k in range(5)] + [("b", 9, 1)], "address string, txid long, height long")
    totals = spark.createDataFrame([("a", 10, 4, 6), ("b", 1, 0, 1), ("c", 0, 0, 0)], "address string, received long, sent long, balance long")
    fees = spark.createDataFrame([(k, 10 * k) for k in range(10)], "txid long, fee long")
    page = lambda *k: {r.address: r for r in A.page(txs, totals, fees, *k).collect()}
    first = page(1, 2)["a"]
    assert (first.total_pages, first["items"], first.txs, first.balance, first.txids, first.transactions) == (3, 2, 5, 6, [4, 2], None)
    assert page(2, 2)["a"].txids == [3, 0] and page(3, 2)["a"].txids == [1] and page(2, 2)["b"].txids == []
    assert page(0, 0)["a"].txids == [4] and page(0, 0)["a"].page == 1 and page(9, 5000)["a"].total_pages == 1 and page(9, 5000)["a"]["items"] == 0
    assert page(1, 2, "txs")["a"].transactions == ["4:102:40", "2:101:20"] and page(1, 2, "txs")["a"].txids is None
    basic = page(1, 2, "basic")["a"]
    assert basic.txids is None and basic.transactions is None and basic["items"] == 2
    assert page(1, 2, "other")["b"].txids == [9]
