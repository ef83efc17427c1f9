"""Where a transaction's value comes from and goes to, and what can be said of inputs that nothing resolves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.ledger import wide


def numbered(joined: DataFrame) -> DataFrame:
    """Inputs with i, their number within the transaction."""
    return joined.withColumn("i", (F.row_number().over(W.partitionBy("txid").orderBy("prev_txid", "prev_vout")) - 1).cast("int"))


def recovered(inputs: DataFrame, out: DataFrame, ptx: DataFrame) -> DataFrame:
    """(txid, i, addr_a, addr_b, value) of the unresolved inputs of coinstakes.

    The addresses are those of the output that was staked: the first funded one with two addresses, else the first
    with any. The value is what the outputs leave after the whole block reward, where there is a single input, and
    null where that is negative or the inputs are several.
    """
    stakes = ptx.where("ty = 1 AND resolved < with_prevout").select("txid", "with_prevout", "out_sum", "era_reward")
    funded = out.where("value > 0 AND addr_a IS NOT NULL").join(stakes.select("txid"), "txid", "left_semi")
    first = F.min(F.struct((F.col("kind") != 2).alias("single"), "vout", "addr_a", "addr_b")).alias("s")
    staked = funded.groupBy("txid").agg(first).select("txid", "s.addr_a", "s.addr_b")
    left = F.col("out_sum") - F.col("era_reward")
    rows = inputs.where("value IS NULL").select("txid", "i").join(stakes, "txid").join(staked, "txid")
    return rows.select("txid", "i", "addr_a", "addr_b", F.when((F.col("with_prevout") == 1) & (left >= 0), left).cast("long").alias("value"))


def edges(joined: DataFrame, out: DataFrame, tx: DataFrame, ptx: DataFrame) -> DataFrame:
    """(txid, src, dst, value): in:<party> to TX, TX to out:<party>, and TX to POOL or POOL to TX for shielded value.

    The party of a cold stake is its owner, the second address. Inputs and outputs without an address are named by
    their numbers. Edges of no value are left out, parallel ones summed.
    """
    inputs = numbered(joined)
    more = recovered(inputs, out, ptx).select("txid", "i", F.coalesce("addr_b", "addr_a").alias("_party"), F.col("value").alias("_value"))
    party = F.coalesce("addr_b", "addr_a", "_party")
    src = F.when(party.isNull(), F.concat(F.lit("coinbase#"), F.col("i").cast("string"))).otherwise(F.concat(F.lit("in:"), party))
    spent = inputs.join(more, ["txid", "i"], "left").select("txid", src.alias("src"), F.lit("TX").alias("dst"), F.coalesce("value", "_value").alias("value"))
    owner = F.coalesce("addr_b", "addr_a")
    dst = F.when(owner.isNull(), F.concat(F.lit("out#"), F.col("vout").cast("string"))).otherwise(F.concat(F.lit("out:"), owner))
    made = out.select("txid", F.lit("TX").alias("src"), dst.alias("dst"), "value")
    inward = F.col("value_balance") < 0
    pool = tx.select("txid", F.when(inward, "TX").otherwise("POOL").alias("src"), F.when(inward, "POOL").otherwise("TX").alias("dst"), F.abs("value_balance").alias("value"))
    every = spent.unionByName(made).unionByName(pool).where("value > 0")
    return every.groupBy("txid", "src", "dst").agg(wide("value").cast("long").alias("value"))
