"""Report views over the daily series and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import div


def transactions_report(days: DataFrame) -> DataFrame:
    return days.select(
        "date", "tx_count", "volume", "payment", "coinstake", "coinbase", F.when(F.col("payment") > 0, div(F.col("volume"), F.greatest("payment", F.lit(1)))).otherwise(0).alias("avg_value"),
        div(F.col("fees_total"), F.greatest("payment", F.lit(1))).alias("avg_fee"), F.when(F.col("normal_tx_bytes") > 0, F.round(F.col("fees_total") / F.col("normal_tx_bytes"), 6)).otherwise(0.0).alias("avg_fee_per_byte"),
        "active_addresses", "new_addresses", "sapling_txs", "coldstake_txs", "coin_days_destroyed",
    )


def staking_report(days: DataFrame, supply: DataFrame) -> DataFrame:
    """supply has one row (total)."""
    d = days.crossJoin(F.broadcast(supply)).withColumns({"blk": F.when(F.col("blocks") > 0, F.col("blocks")).otherwise(F.greatest("coinstake", F.lit(1))), "weight": F.col("avg_difficulty") * 8_796_093_022_208.0 / 60.0})
    staked = F.floor("weight").cast("long")
    pct = lambda a: F.when(F.col("weight") > 0, F.round(F.col(a).cast("double") * 365.0 / F.col("weight") * 100.0, 6)).otherwise(0.0)
    return d.select(
        "date", F.when((F.col("total") > 0) & (staked > 0), F.round(staked.cast("double") / F.col("total") * 100.0, 6)).otherwise(0.0).alias("participation_rate"), F.col("unique_stakers").alias("active_stakers"), "rewards_total",
        F.round(86400.0 / F.col("blk"), 6).alias("avg_block_time"), div(F.col("stake_volume"), F.greatest("coinstake", F.lit(1))).alias("avg_stake_size"), pct("staker_rewards_total").alias("apy_estimate"), pct("rewards_total").alias("gross_yield_estimate"),
        F.round(F.col("top10_blocks") / F.col("blk") * 100.0, 6).alias("top10_dominance"),
    )


def network_report(days: DataFrame) -> DataFrame:
    b, o = F.col("blocks"), F.col("orphan_blocks")
    return days.where("blocks > 0").select("date", F.col("avg_difficulty").alias("difficulty"), F.round(o / (o + b) * 100.0, 6).alias("orphan_rate"), "blocks", div(F.col("tx_bytes") + b * 113, b).alias("avg_block_size"), "interval_p95_secs", "interval_max_secs")


def delegation_curve(daily: DataFrame) -> DataFrame:
    """Cumulative net delegation, exact beyond 64 bits; one row a day, so the window is small."""
    run = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    net = (F.col("p2cs_created") - F.col("p2cs_spent")).cast("decimal(28,0)")
    return daily.select("date", "blocks", "p2cs_created", "p2cs_spent", F.sum(net).over(run).cast("decimal(38,0)").alias("cumulative"), "coldstake_txs")
