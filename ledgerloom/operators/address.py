"""Per-address products: totals, transaction lists, unspent outputs, balance histories and account scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import div
from ..plans.scratch import written
from ..sources.ledger import wide
from .joins import attributed


def address_totals(credit: DataFrame, debit: DataFrame) -> DataFrame:
    """(address, received, sent, balance) of addresses that ever held a value; partial sums leave few rows per hot address."""
    zero = F.lit(0).cast("long")
    both = credit.select("address", F.col("value").alias("r"), zero.alias("s")).unionByName(debit.select("address", zero.alias("r"), F.col("value").alias("s")))
    g = both.groupBy("address").agg(wide("r").alias("r"), wide("s").alias("s"), F.max("r").alias("m")).where("m > 0 OR s > 0")
    return g.select("address", F.col("r").cast("long").alias("received"), F.col("s").cast("long").alias("sent"), (F.col("r") - F.col("s")).cast("long").alias("balance"))


def address_txs(credit: DataFrame, debit: DataFrame) -> DataFrame:
    return credit.select("address", "txid", "height").unionByName(debit.select("address", "txid", "height")).distinct()


def touching(asked: DataFrame, made: DataFrame, spends: DataFrame) -> DataFrame:
    """address_txs of asked(address), a bounded number of addresses: (address, txid, height).

    Outputs are cut down to theirs before they meet the inputs, so neither all credits nor all debits are made.
    """
    theirs = attributed(made).join(F.broadcast(asked.select("address")), "address", "left_semi")
    theirs = written(theirs.select("address", "txid", "vout", "height", "ty"), False)
    spent = theirs.where("height >= 0").select("address", F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"))
    return theirs.where("NOT (ty = 1 AND vout = 0)").select("address", "txid", "height").unionByName(spends.join(spent, ["prev_txid", "prev_vout"]).select("address", "txid", "height")).distinct()


def utxo_table(credit: DataFrame, unspent: DataFrame) -> DataFrame:
    return credit.where("value > 0").join(unspent.select("txid", "vout"), ["txid", "vout"], "left_semi").select("address", "txid", "vout", "value", "ty", "height")


def flows(credit: DataFrame, debit: DataFrame) -> DataFrame:
    """(address, txid, height, received, spent) for each transaction of each address."""
    zero = F.lit(0).cast("long")
    both = credit.select("address", "txid", "height", F.col("value").alias("r"), zero.alias("s")).unionByName(debit.select("address", "txid", "height", zero.alias("r"), F.col("value").alias("s")))
    return both.groupBy("address", "txid", "height").agg(wide("r").cast("long").alias("received"), wide("s").cast("long").alias("spent"))


def balance_history(flow: DataFrame, block: DataFrame, group: int = 3600) -> DataFrame:
    """Buckets of `group` seconds per address: txs, received, sent, sent_to_self. Heights <= 0 don't count; a missing time is an error."""
    if not 60 <= group <= 2_592_000:
        raise ValueError("group must lie between 60 and 2592000 seconds")
    timed = flow.where("height > 0").join(block.select("height", "ntime"), "height", "left")
    t = F.when(F.col("ntime").isNull(), F.raise_error(F.lit("a transaction's block has no time"))).otherwise(F.col("ntime")).cast("long")
    own = F.when(F.col("spent") > 0, F.col("received")).otherwise(0)
    return timed.groupBy("address", (div(t, group) * group).alias("bucket")).agg(
        F.count("*").alias("txs"), wide("received").cast("long").alias("received"), wide("spent").cast("long").alias("sent"), wide(own).cast("long").alias("sent_to_self")
    )


def balance_curve(history: DataFrame) -> DataFrame:
    run = W.partitionBy("address").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return history.select("address", "bucket", F.sum((F.col("received") - F.col("sent")).cast("decimal(28,0)")).over(run).cast("long").alias("balance"))


def gap_scan(derived: DataFrame, used: DataFrame, gap: int = 20, max_scan: int = 1000) -> DataFrame:
    """(account, chain, idx, address, is_used) that a scan reaches: it ends after `gap` unused addresses in a row."""
    rows = derived.where(F.col("idx") < max_scan).join(used.select("address", F.lit(True).alias("_u")), "address", "left")
    by = W.partitionBy("account", "chain").orderBy("idx")
    last = F.coalesce(F.max(F.when(F.col("_u"), F.col("idx"))).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    r = rows.withColumn("_late", F.col("idx") - last > gap)
    stopped = F.max("_late").over(by.rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("_stop", stopped).where("NOT _stop").select("account", "chain", "idx", "address", F.coalesce("_u", F.lit(False)).alias("is_used"))


def account_rollup(derived: DataFrame, totals: DataFrame, txs: DataFrame) -> DataFrame:
    n = txs.groupBy("address").agg(F.count("*").alias("n"))
    rows = derived.join(totals, "address", "left").join(n, "address", "left")
    s = lambda c: F.coalesce(wide(c), F.lit(0)).cast("long")
    return rows.groupBy("account").agg(s("received").alias("received"), s("sent").alias("sent"), s("balance").alias("balance"), F.count("n").alias("used"), F.coalesce(F.sum("n"), F.lit(0)).alias("transfers"))


def page(txs: DataFrame, totals: DataFrame, details: DataFrame, number: int, size: int, level: str = "txids") -> DataFrame:
    """One row for each address of txs(address, txid, height): page, total_pages, items, txs, balance, received, sent, txids, transactions.

    Newest first by height, equal heights by txid. number is at least 1, size from 1 to 1000; there is at least one
    page, and a page past the end is empty. level: basic (neither list), txids, or txs, which has txid:height:fee
    of details(txid, fee) for each transaction; any other word counts as txids.
    """
    number, size = max(1, number), min(max(1, size), 1000)
    newest = W.partitionBy("address").orderBy(F.desc("height"), "txid")
    place = txs.withColumn("_pos", F.row_number().over(newest))
    here = place.where(F.col("_pos").between((number - 1) * size + 1, number * size))
    if level == "txs":
        here = here.join(details.select("txid", "fee"), "txid")
    entry = F.concat_ws(":", *(F.col(c).cast("string") for c in ("txid", "height", "fee"))) if level == "txs" else F.lit("")
    lists = F.sort_array(F.collect_list(F.struct("_pos", "txid", entry.alias("_e"))))  # at most `size` entries
    listed = here.groupBy("address").agg(F.count("*").alias("items"), lists.alias("_l"))
    id_type = dict(txs.dtypes)["txid"]
    none, empty = F.lit(None), F.array()
    txids = none.cast(f"array<{id_type}>") if level in ("basic", "txs") else F.coalesce(F.col("_l.txid"), empty.cast(f"array<{id_type}>"))
    whole = F.coalesce(F.col("_l._e"), empty.cast("array<string>")) if level == "txs" else none.cast("array<string>")
    n = txs.groupBy("address").agg(F.count("*").alias("txs"))
    rows = n.join(totals, "address").join(listed, "address", "left")
    return rows.select(
        "address", F.lit(number).alias("page"), F.greatest(div(F.col("txs") + size - 1, size), F.lit(1)).alias("total_pages"), F.coalesce("items", F.lit(0)).cast("long").alias("items"),
        "txs", "balance", "received", "sent", txids.alias("txids"), whole.alias("transactions"),
    )
