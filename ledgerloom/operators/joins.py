"""Joins over ledger tables: prevout resolution, the unspent set, spends, heights and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import written


def prevout_join(inp: DataFrame, out: DataFrame, tx: DataFrame) -> DataFrame:
    """Each input with the output it spends (value, kind, addr_a, addr_b, prev_height), null where there is none.

    The build side holds outputs of transactions with height >= 0 only. Both sides are keyed by the outpoint:
    the one large shuffle; AQE splits skewed partitions.
    """
    return resolve(inp, out.join(tx.where("height >= 0").select("txid", "height"), "txid"))


def resolve(inp: DataFrame, made: DataFrame) -> DataFrame:
    """prevout_join with outputs that carry their height."""
    build = made.select(F.col("txid").alias("_t"), F.col("vout").alias("_v"), "value", "kind", "addr_a", "addr_b", F.col("height").alias("prev_height"))
    return inp.join(build, (F.col("prev_txid") == F.col("_t")) & (F.col("prev_vout") == F.col("_v")), "left").drop("_t", "_v")


def unspent(out: DataFrame, inp: DataFrame) -> DataFrame:
    spent = inp.select(F.col("prev_txid").alias("_t"), F.col("prev_vout").alias("_v"))
    return out.join(spent, (F.col("txid") == F.col("_t")) & (F.col("vout") == F.col("_v")), "left_anti")


def attributed(rows: DataFrame) -> DataFrame:
    """One row for each address of rows(kind, addr_a, addr_b): kind 2 gives two, each with the full value."""
    return rows.where("kind > 0").withColumn("address", F.explode(F.array_compact(F.array("addr_a", "addr_b")))).drop("addr_a", "addr_b")


def credits(out: DataFrame, tx: DataFrame) -> DataFrame:
    """(txid, vout, value, height, ty, address) of each address that an output pays; a coinstake's output 0 pays none.

    A date in tx is kept: so dated, credits need no join by height, which would move every one of them again.
    """
    return paid(out.where("kind > 0").join(tx.select("txid", "height", "ty", *_date(tx)), "txid"))


def _date(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "date"]


def paid(made: DataFrame) -> DataFrame:
    """credits of outputs that carry their transaction's height and type."""
    return attributed(made.where("NOT (ty = 1 AND vout = 0)")).select("txid", "vout", "value", "height", "ty", "address", *_date(made))


def debits(joined: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """(txid, value, height, address) of each address that a resolved input spends from; without tx, joined has the spender's height."""
    rows = attributed(joined)
    return (rows if tx is None else rows.join(tx.select("txid", "height"), "txid")).select("txid", "value", "height", "address")


def spend_records(joined: DataFrame, tx: DataFrame) -> DataFrame:
    """Each resolved spend: outpoint, value, heights, the spending transaction and its input's number, by outpoint."""
    spender = tx.select("txid", F.col("height").alias("spent_height"))
    number = F.row_number().over(W.partitionBy("txid").orderBy("prev_txid", "prev_vout")) - 1  # on the join's own partitioning
    return joined.join(spender, "txid").withColumn("spent_vin", number.cast("int")).where("value IS NOT NULL").select(
        "prev_txid", "prev_vout", "value", F.col("prev_height").alias("created_height"), "spent_height", F.col("txid").alias("spent_by"), "spent_vin"
    )


def input_values(joined: DataFrame) -> DataFrame:
    """(txid, input_value): null where any input is unresolved."""
    g = joined.groupBy("txid").agg(F.count("*").alias("n"), F.count("value").alias("m"), F.sum(F.col("value").cast("decimal(28,0)")).alias("v"))
    return g.select("txid", F.when(F.col("n") == F.col("m"), F.col("v")).cast("long").alias("input_value"))


def resolve_heights(stored: DataFrame, block_tx: DataFrame, canonical: DataFrame) -> DataFrame:
    """(txid, height) of stored(txid, height) after resolution.

    A height of 0, -1 or -2 takes the lowest canonical height that block_tx names for the txid, else -1. A
    positive height becomes -1 only if it is neither canonical nor named by block_tx.
    """
    known = canonical.select(F.col("height").alias("_c"))
    named = block_tx.select("txid", F.col("height").alias("_h"))
    best = named.join(known, F.col("_h") == F.col("_c"), "left_semi").groupBy("txid").agg(F.min("_h").alias("_best"))
    here = named.select("txid", F.col("_h").alias("height"), F.lit(True).alias("_named")).distinct()
    rows = stored.join(best, "txid", "left").join(here, ["txid", "height"], "left").join(known, F.col("height") == F.col("_c"), "left")
    return rows.select("txid", F.when(F.col("height") <= 0, F.coalesce("_best", F.lit(-1))).when(F.col("_c").isNull() & F.col("_named").isNull(), -1).otherwise(F.col("height")).cast("long").alias("height"))


def reconcile(a: DataFrame, b: DataFrame, minimum: int = 0) -> DataFrame:
    """One row of counts for two tables (address, balance)."""
    j = a.select("address", F.col("balance").alias("x")).join(b.select("address", F.col("balance").alias("y")), "address", "full")
    diff = F.abs(F.col("x") - F.col("y"))
    count = lambda c: F.count(F.when(c, 1))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.agg(
        count(both & (diff <= 1)).alias("matched"), count(both & (diff > 1)).alias("mismatched"), count(both & (diff > 1_000_000)).alias("significant"),
        count(F.col("y").isNull() & (F.col("x") >= minimum)).alias("left_only"), count(F.col("x").isNull() & (F.col("y") >= minimum)).alias("right_only"),
        F.coalesce(F.sum(diff.cast("decimal(28,0)")), F.lit(0)).cast("long").alias("abs_diff"),
    )


def spent_flags(made: DataFrame, inp: DataFrame, *more: str) -> DataFrame:
    """(txid, vout, *more, spent) of outputs with their height and type: null for no address, height <= 0 or an address
    that never received a value; false if it is unspent, has a value and pays somebody.

    An output that pays a value makes its own address known, where no value is negative: addresses are looked up only
    for the others.
    """
    keys = inp.select(F.col("prev_txid").alias("_t"), F.col("prev_vout").alias("_v")).distinct().withColumn("_spent", F.lit(True))
    rows = made.join(keys, (F.col("txid") == F.col("_t")) & (F.col("vout") == F.col("_v")), "left")
    pays = F.coalesce(F.expr("kind > 0 AND value > 0 AND NOT (ty = 1 AND vout = 0)"), F.lit(False))
    live = F.col("_spent").isNull() & pays
    own = pays if made.where("value < 0").isEmpty() else F.lit(False)
    asked = written(made.where("addr_a IS NOT NULL AND height > 0").where(~own).select(F.col("addr_a").alias("address")).distinct(), False)
    received = paid(made).join(asked, "address", "left_semi").groupBy("address").agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("_r"))
    known = written(received.where("_r > 0").select(F.col("address").alias("_a")), False)
    flag = lambda unknown: F.when(F.col("addr_a").isNull() | (F.col("height") <= 0) | unknown, None).otherwise(~live).alias("spent")
    if known.isEmpty():
        return rows.select("txid", "vout", *more, flag(~own & ~live))
    looked = rows.join(known, F.col("addr_a") == F.col("_a"), "left")
    return looked.select("txid", "vout", *more, flag(~own & ~live & F.col("_a").isNull()))


def previous_by_height(block: DataFrame, *columns: str) -> DataFrame:
    """block with prev_<column> of the block one lower, where there is one: an equi-join, not a window over all."""
    lower = block.select((F.col("height") + 1).alias("height"), *(F.col(c).alias(f"prev_{c}") for c in columns))
    return block.join(lower, "height", "left")


def newest_first(df: DataFrame, by: str, order: list, page: int, size: int) -> DataFrame:
    """Rows page of each `by` in the given order."""
    n = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("pos", n).where(F.col("pos").between((page - 1) * size + 1, page * size))
