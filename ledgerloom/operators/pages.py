"""What explorer pages show: transactions with their inputs and outputs, search, attribution and coin-set balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.ledger import wide

#: What a decoder puts in place of an address.
MARKERS = ("CoinBaseTx", "CoinStakeTx", "Nonstandard")


def attribution(addresses: Column, value: Column, script: Column) -> Column:
    """struct(kind, addr_a, addr_b) of an output from its decoded addresses, value and upper-case hex script.

    Kind 2 is cold staking (staker, owner), 1 a single owner, 0 nobody: no address, a marker, an empty or data script
    of value 0, or several addresses of another script. Null addresses count as none, a null script as empty.
    """
    found, code = F.coalesce(addresses, F.array().cast("array<string>")), F.coalesce(script, F.lit(""))
    n = F.size(found)
    marked = F.arrays_overlap(found, F.array(*(F.lit(m) for m in MARKERS)))
    data = (value == 0) & ((code == "") | code.startswith("6A"))
    kind = F.when((n == 0) | marked | data, 0).when((S.script_type(code) == "coldstake") & (n == 2), 2).when(n == 1, 1).otherwise(0)
    pick = lambda least, i: F.when(kind >= least, F.get(found, i))
    return F.struct(kind.alias("kind"), pick(1, 0).alias("addr_a"), pick(2, 1).alias("addr_b"))


def _gathered(*fields: str) -> Column:
    owners = F.array_compact(F.array("addr_a", "addr_b")).alias("addresses")
    return F.sort_array(F.collect_list(F.struct(*(owners if f == "addresses" else f for f in fields))))


def vin_list() -> Column:
    """A transaction's inputs by outpoint, each with the resolved value (null if there is none) and addresses."""
    return _gathered("prev_txid", "prev_vout", "value", "addresses").alias("vin")


def vout_list() -> Column:
    """A transaction's outputs by number, each with the spent flag."""
    return _gathered("vout", "value", "addresses", "spent").alias("vout")


def transaction_pages(sums: DataFrame, tip: DataFrame) -> DataFrame:
    """One row per transaction: height, confirmations, fee, in_sum, out_sum, vin[] and vout[].

    sums are those of per_transaction with vin_list and vout_list. A side without rows is an empty array. What is
    gathered belongs to one transaction.
    """
    fee = F.greatest(F.col("in_sum") + F.col("value_balance") - F.col("out_sum"), F.lit(0)).cast("long")
    both = sums.crossJoin(F.broadcast(tip.select("tip")))  # tip is one row
    return both.select(
        "txid", "height", S.confirmations(F.col("height"), F.col("tip")).alias("confirmations"), fee.alias("fee"), "in_sum", "out_sum",
        F.coalesce("vin", F.array()).alias("vin"), F.coalesce("vout", F.array()).alias("vout"),
    )


def search(asked: DataFrame, block: DataFrame, chain: DataFrame, tx: DataFrame, totals: DataFrame, account: DataFrame) -> DataFrame:
    """asked(q) with found (block, tx, address, account or not-found) and height.

    Blanks around a query don't count; a block's number or hash goes before a transaction, address or account of the
    same name. Every table is cut down to the names asked for before anything is grouped.
    """
    none = F.lit(None).cast("long")
    row = lambda df, key, rank, found, height=none: df.select(key.cast("string").alias("key"), F.struct(F.lit(rank).alias("rank"), F.lit(found).alias("found"), height.alias("height")).alias("hit"))
    names = (
        row(block, F.col("height"), 1, "block", F.col("height")), row(chain, F.col("block_hash"), 2, "block", F.col("true_height")),
        row(tx, F.concat(F.lit("T"), F.col("txid").cast("string")), 3, "tx", F.col("height")),
        row(totals, F.col("address"), 4, "address"), row(account, F.concat(F.lit("xpub"), F.col("account").cast("string")), 5, "account"),
    )
    queries = asked.withColumn("key", F.trim("q"))
    wanted = queries.select("key").distinct()
    hits = names[0]
    for other in names[1:]:
        hits = hits.unionByName(other)
    best = hits.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("hit").alias("hit"))
    return queries.join(best, "key", "left").select("q", F.coalesce("hit.found", F.lit("not-found")).alias("found"), F.col("hit.height").alias("height"))


def coin_set(coins: DataFrame, coinbase: bool = True, maturity: int | None = None, tip: int | None = None, unknown: bool = False, shielded: bool = False) -> DataFrame:
    """(address, balance, coinbase_balance) of coins(addresses, value, is_coinbase, height, script).

    A coinbase coin always counts in coinbase_balance, and in balance only if `coinbase` is set and, where maturity and
    tip are given, tip >= height + maturity. Coins without address go to UNKNOWN_ and UNKNOWN_COINBASE_ with the first
    six script bytes in lower case, and to SHIELDED_UNKNOWN, if asked for; markers and values of 0 count nowhere. A
    coin of two addresses counts for both.
    """
    mature = F.lit(True) if maturity is None or tip is None else F.col("height") + maturity <= tip
    accepted = ~F.col("is_coinbase") | (F.lit(coinbase) & mature)
    prefix, zero = F.lower(F.substring("script", 1, 12)), F.lit(0).cast("long")
    minted = F.when(F.col("is_coinbase"), F.col("value")).otherwise(zero)
    entry = lambda key, balance, minted_: F.struct(key.alias("address"), balance.alias("v"), minted_.alias("c"))
    owned = F.transform(F.array_except("addresses", F.array(*(F.lit(m) for m in MARKERS))), lambda a: entry(a, F.when(accepted, F.col("value")).otherwise(zero), minted))
    nobody = [F.when(F.col("is_coinbase"), entry(F.concat(F.lit("UNKNOWN_COINBASE_"), prefix), zero, minted))]
    if unknown:
        nobody.append(entry(F.concat(F.lit("UNKNOWN_"), prefix), F.col("value"), zero))
    if shielded:
        nobody.append(entry(F.lit("SHIELDED_UNKNOWN"), F.col("value"), minted))
    entries = F.when(F.size("addresses") > 0, owned).otherwise(F.array_compact(F.array(*nobody)))
    rows = coins.where("value <> 0").select(F.explode(entries).alias("e")).select("e.*").where("v <> 0 OR c <> 0")
    return rows.groupBy("address").agg(wide("v").cast("long").alias("balance"), wide("c").cast("long").alias("coinbase_balance"))
