"""Totals beyond 64 bits: exact, and as the SQL has them where they fit."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reports as R
from ledgerloom.operators import wealth as V
from ledgerloom.plans import catalog, catalog_more, catalog_pages  # noqa: F401
from ledgerloom.plans.scratch import exact
from ledgerloom.sources.ledger import Ledger

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ledgers(spark):
    """The small ledger, and one whose outputs are worth so many times as much."""
    plain, rich = Ledger(spark, SF, keep=True), Ledger(spark, SF, keep=True)
    for name in ("tx", "block", "inp"):
        rich.views[name] = getattr(plain, name)
    # Many whole ledgers' worth of value in as many outputs as one has: no single one is beyond 64 bits.
    rich.views["out"] = plain.out.withColumn("value", F.col("value") * 1000)
    return SimpleNamespace(plain=plain, rich=rich)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("cumulative_delegation", ["cumulative"]), ("cold_staking_report", ["cumulative"]), ("hodl_bands", ["value"]), ("hodl_report", ["value"]), ("shield_supply", ["transparent"]),
        ("supply_snapshot", ["transparent", "staked"]), ("supply_denominator", ["denominator"]), ("utxo_delta", ["value"]), ("wealth_sums", ["total", "top1000"]), ("wealth_segments", ["others", "top10"]),
    ],
)
def test_totals_grow_with_values(ledgers, name, columns):
    """A thousand times the value gives exactly a thousand times each total, though one is beyond 64 bits."""
    total = lambda L: [catalog.OPERATORS[name](L).agg(F.sum(F.col(c).cast("decimal(38,0)"))).first()[0] for c in columns]
    small, large = total(ledgers.plain), total(ledgers.rich)
    assert [int(x) * 1000 for x in small] == [int(x) for x in large]
    assert dict(catalog.OPERATORS[name](ledgers.plain).dtypes)[columns[0]] == "bigint"


@pytest.mark.parametrize("name", ["rich_list_report", "wealth_report", "treasury_total"])
def test_reports_over_large_totals(ledgers, name):
    assert catalog.OPERATORS[name](ledgers.rich).count() > 0


def test_sums_beyond_64_bits(spark):
    t = spark.createDataFrame([(f"a{k}", (1 << 63) - 1 - k) for k in range(5)], "address string, balance long")
    want = sum((1 << 63) - 1 - k for k in range(5))
    got = exact(V.top_shares(t), "total", "top10").first()
    assert (got.total, got.top10) == (want, want)
    utxo = spark.createDataFrame([(k, 0, 1 << 62, 5) for k in range(3)], "txid long, vout int, value long, height long")
    assert exact(V.hodl_bands(utxo, spark.createDataFrame([(5,)], "tip long")), "value").first().value == 3 << 62
    days = spark.createDataFrame([(f"2020-01-0{k}", 1, 1 << 62, 0, 0) for k in range(1, 5)], "date string, blocks long, p2cs_created long, p2cs_spent long, coldstake_txs long")
    assert [int(r.cumulative) for r in exact(R.delegation_curve(days).orderBy("date"), "cumulative").orderBy("date").collect()] == [k << 62 for k in range(1, 5)]
    few = exact(V.top_shares(t.where("address = 'a1'")), "total")
    assert dict(few.dtypes)["total"] == "bigint" and few.first().total == (1 << 63) - 2
