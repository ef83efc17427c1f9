"""How often rows move: each query's plan over stored base tables, with no join small enough to broadcast by itself."""

import pytest

from ledgerloom.operators import joins as J
from ledgerloom.plans import catalog, catalog_flow, catalog_live, catalog_pages  # noqa: F401
from ledgerloom.sources.ledger import ingested

SF = "/root/testdata/sf0.001"


@pytest.fixture
def ledger(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield ingested(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def moves(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [
    ("transaction_page", 7), ("output_spent_flag", 2), ("transaction_detail", 5), ("block_detail", 6), ("value_flow_edges", 4), ("prevout_join", 2), ("totals", 3),
    ("rich_list", 5), ("address_page", 4), ("address_page_levels", 21), ("network_report", 10),
])
def test_moves(name, most, ledger):
    df = catalog.totals(ledger) if name == "totals" else catalog.OPERATORS[name](ledger)
    assert moves(df) <= most


def test_products_are_not_grouped(ledger):
    """Edges are unique once both sides are: nothing is aggregated above their join."""
    plan = catalog.OPERATORS["value_flow_edges"](ledger)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


MADE = "txid long, vout int, value long, kind int, addr_a string, addr_b string, height long, ty int"


def test_spent_flags_of_outputs_that_pay_nothing(spark):
    """An address that only got nothing is unknown, one that was paid elsewhere is known; no height or address tells nothing."""
    made = [
        (1, 0, 5, 1, "a", None, 3, 0), (1, 1, 0, 1, "a", None, 3, 0), (1, 2, 0, 1, "b", None, 3, 0), (2, 0, 7, 1, "c", None, 0, 0), (2, 1, 7, 0, None, None, 3, 0),
        (3, 0, 9, 1, "d", None, 3, 0), (4, 0, 9, 2, "s", "o", 3, 0), (4, 1, None, 1, "s", None, 3, 0), (5, 0, 4, 1, "e", None, 4, 1), (6, 0, -3, 1, "f", None, 3, 0), (6, 1, 2, 1, "f", None, 3, 0),
    ]
    inp = spark.createDataFrame([(9, 3, 0), (8, 3, 0), (9, 4, 0), (9, 6, 1)], "txid long, prev_txid long, prev_vout int")
    want = {(1, 0): False, (1, 1): True, (1, 2): None, (2, 0): None, (2, 1): None, (3, 0): True, (4, 0): True, (4, 1): True, (5, 0): None}
    rows = lambda m: {(r.txid, r.vout): r.spent for r in J.spent_flags(spark.createDataFrame(m, MADE), inp).collect()}
    assert rows(made[:-2]) == want
    assert rows(made) == want | {(6, 0): None, (6, 1): None}


def test_feed_by_height_is_the_feed(ledger):
    """The lane's feed moves each row once, to its range of heights, and holds what feed holds."""
    from ledgerloom.streaming import lane

    mine = lane.feed_by_height(ledger.tx, ledger.spends, ledger.made)
    assert moves(mine) == 0
    rows = lambda df: {r.txid: (r.height, r.ty, r.value_balance, sorted(r.outs or [], key=str), sorted(r.ins or [], key=str)) for r in df.collect()}
    got, want = mine.collect(), rows(lane.feed(ledger.tx, ledger.inp, ledger.out))
    assert len(got) == len(want) and rows(mine) == want
