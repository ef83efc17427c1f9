"""The daily series: per-transaction arithmetic and its sums by UTC date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import COIN, difficulty, div, with_era
from ..sources.ledger import wide
from .joins import previous_by_height


def per_transaction(tx: DataFrame, out: DataFrame, joined: DataFrame, era_scale: int = 1, of_out: tuple[Column, ...] = (), of_in: tuple[Column, ...] = ()) -> DataFrame:
    """One row per transaction with its sums, fee, rewards, treasury payout and coin age.

    Outputs and inputs are aggregated by txid before they meet; of_out and of_in are what else is made of them in the
    same pass, null where there are none. joined may carry the spender's height. The height that picks the era is
    height * era_scale. coin_age is exact: satoshi times blocks.
    """
    o = out.groupBy("txid").agg(
        wide("value").alias("out_sum"), F.count("*").alias("n_outputs"), F.sum(F.when(F.col("kind") == 2, F.col("value")).otherwise(0)).alias("p2cs_created"), F.max((F.col("kind") == 2).cast("int")).alias("coldstake"),
        *of_out,
    )
    with_height = joined if "height" in joined.columns else joined.join(tx.select("txid", "height"), "txid")
    age = F.when((F.col("prev_height") >= 0) & (F.col("height") >= F.col("prev_height")), F.col("value").cast("decimal(20,0)") * (F.col("height") - F.col("prev_height")).cast("decimal(10,0)"))
    i = with_height.groupBy("txid").agg(
        wide("value").alias("in_sum"), F.count("*").alias("with_prevout"), F.count("value").alias("resolved"), F.sum(F.when(F.col("kind") == 2, F.col("value")).otherwise(0)).alias("p2cs_spent"), F.sum(age).alias("coin_age"), *of_in
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast(t) for c, t in (("out_sum", "long"), ("n_outputs", "long"), ("p2cs_created", "long"), ("coldstake", "int"), ("in_sum", "long"), ("with_prevout", "long"), ("resolved", "long"), ("p2cs_spent", "long"), ("coin_age", "decimal(38,0)"))}
    t = with_era(tx.join(o, "txid", "left").join(i, "txid", "left").withColumns(zero).withColumn("era_height", F.col("height") * era_scale))
    return t.withColumns(join_arithmetic())


def join_arithmetic() -> dict[str, Column]:
    """fee, rewards, staker_rewards, treasury, raw_len and normal_bytes from a transaction's sums and era."""
    all_in = F.col("resolved") == F.col("with_prevout")
    fee = F.col("in_sum") + F.col("value_balance") - F.col("out_sum")
    raw = 100 + 150 * F.col("with_prevout") + 34 * F.col("n_outputs")
    minted = F.col("out_sum") - F.col("in_sum")
    excess = minted - F.col("era_reward")
    stake = (F.col("ty") == 1) & all_in & (minted > 0)
    budget = stake & (excess > 100 * COIN)
    return {
        "raw_len": raw.cast("long"),
        "normal_bytes": F.when(F.col("ty") == 0, raw).otherwise(0).cast("long"),
        "fee": F.when((F.col("ty") == 0) & (F.col("with_prevout") > 0) & all_in & (fee > 0) & (fee < 1000 * COIN), fee).otherwise(0).cast("long"),
        "rewards": F.when(budget, F.col("era_reward")).when(stake, minted).otherwise(0).cast("long"),
        "staker_rewards": F.when(stake, F.least("era_staker", minted)).otherwise(0).cast("long"),
        "treasury": F.when(budget, excess).when((F.col("ty") == 2) & (F.col("height") > 0) & (F.col("out_sum") - F.col("era_reward") > 10 * COIN), F.col("out_sum") - F.col("era_reward")).otherwise(0).cast("long"),
    }


def _counts() -> list[Column]:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    ty = F.col("ty")
    return [
        F.count("*").alias("tx_count"), F.sum("raw_len").alias("tx_bytes"), n(F.col("value_balance") != 0).alias("sapling_txs"), n(ty == 2).alias("coinbase"), n(ty == 1).alias("coinstake"), n(ty == 0).alias("payment"),
        wide(F.when(ty == 0, F.col("out_sum")).otherwise(0)).cast("long").alias("volume"), wide(F.when(ty == 1, F.col("out_sum")).otherwise(0)).cast("long").alias("stake_volume"), n((ty == 1) & (F.col("coldstake") == 1)).alias("coldstake_txs"),
    ]


def _sums() -> list[Column]:
    s = lambda c, name: wide(c).cast("long").alias(name)
    coin_days = (F.sum("coin_age").cast("double") / (1440.0 * COIN)).alias("coin_days_destroyed")
    return [
        s("fee", "fees_total"), F.sum("normal_bytes").alias("normal_tx_bytes"), s("rewards", "rewards_total"), s("staker_rewards", "staker_rewards_total"), coin_days,
        s("p2cs_created", "p2cs_created"), s("p2cs_spent", "p2cs_spent"),
    ]


def _by_date(ptx: DataFrame, block: DataFrame, sums: list[Column]) -> DataFrame:
    return _dated(ptx, block).groupBy("date").agg(*sums)


def inline_counts(ptx: DataFrame, block: DataFrame) -> DataFrame:
    """By date: counts, bytes and volumes of per_transaction rows."""
    return _by_date(ptx, block, _counts())


def join_sums(ptx: DataFrame, block: DataFrame) -> DataFrame:
    """By the spender's date: fees, rewards, bytes, coin days destroyed and delegation flows."""
    return _by_date(ptx, block, _sums())


def day_sums(ptx: DataFrame, block: DataFrame) -> DataFrame:
    """inline_counts and join_sums in one pass."""
    return _by_date(ptx, block, _counts() + _sums())


def treasury_payouts(ptx: DataFrame, block: DataFrame) -> DataFrame:
    return _dated(ptx.where("treasury > 0"), block).select("height", "date", F.col("treasury").alias("total_paid"), "n_outputs")


def difficulty_by_day(block: DataFrame) -> DataFrame:
    return block.groupBy("date").agg(F.round(F.avg(difficulty("nbits")), 6).alias("avg_difficulty"), F.count("*").alias("blocks"))


def stakers_by_day(tx: DataFrame, out: DataFrame, block: DataFrame) -> DataFrame:
    """unique_stakers and the blocks that the day's ten largest won; a staker is the first address of the first addressed output."""
    first = out.where("addr_a IS NOT NULL").groupBy("txid").agg(F.min_by("addr_a", "vout").alias("staker"))
    won = tx.where("ty = 1").select("txid", "height").join(first, "txid").join(block.select("height", "date"), "height").groupBy("date", "staker").agg(F.count("*").alias("n"))
    return winners(won)


def winners(won: DataFrame) -> DataFrame:
    """stakers_by_day of the number n of blocks that each staker won on each date."""
    ranked = won.withColumn("r", F.row_number().over(W.partitionBy("date").orderBy(F.desc("n"), "staker")))
    return ranked.groupBy("date").agg(F.count("*").alias("unique_stakers"), F.sum(F.when(F.col("r") <= 10, F.col("n")).otherwise(0)).alias("top10_blocks"))


def _dated(rows: DataFrame, block: DataFrame) -> DataFrame:
    return rows if "date" in rows.columns else rows.join(block.select("height", "date"), "height")


def active_by_day(credit: DataFrame, block: DataFrame) -> DataFrame:
    return _dated(credit, block).select("date", "address").distinct().groupBy("date").agg(F.count("*").alias("active_addresses"))


def new_by_day(credit: DataFrame, block: DataFrame) -> DataFrame:
    # The least day as a date: strings would be sorted, and spilled, before they are aggregated.
    first = _dated(credit, block).groupBy("address").agg(F.min(F.to_date("date")).alias("day"))
    return first.groupBy(F.date_format("day", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("new_addresses"))


def block_intervals(block: DataFrame) -> DataFrame:
    """(height, date, interval): seconds since the block before, 0 if time ran backwards."""
    j = previous_by_height(block.select("height", "date", "ntime"), "ntime").where("prev_ntime IS NOT NULL")
    return j.select("height", "date", F.greatest(F.col("ntime") - F.col("prev_ntime"), F.lit(0)).alias("interval"))


def interval_stats_by_day(block: DataFrame) -> DataFrame:
    """The longest interval and sorted[min(n * 95 div 100, n - 1)] of each day."""
    one_day = W.partitionBy("date")
    r = block_intervals(block).withColumns({"r": F.row_number().over(one_day.orderBy("interval", "height")) - 1, "n": F.count("*").over(one_day)})
    pick = F.least(div(F.col("n") * 95, 100), F.col("n") - 1)
    return r.groupBy("date").agg(F.max(F.when(F.col("r") == pick, F.col("interval"))).alias("interval_p95_secs"), F.max("interval").alias("interval_max_secs"))


def _stale(chain: DataFrame, block: DataFrame, margin: int) -> DataFrame:
    """Headers that aren't canonical, each hash once, if they are older than the tip's time less the margin."""
    tip = block.agg(F.max_by("ntime", "height").alias("tip_time"))
    canonical = block.select(F.concat(F.lit("B"), F.col("height").cast("string")).alias("block_hash"))
    stale = chain.join(canonical, "block_hash", "left_anti").dropDuplicates(["block_hash"]).crossJoin(F.broadcast(tip))  # tip is one row
    return stale.where((F.col("ntime") != 0) & (F.col("ntime") < F.col("tip_time") - margin))


def orphans_by_day(chain: DataFrame, block: DataFrame, utc_date, margin: int = 7200) -> DataFrame:
    """Stale blocks by their own date."""
    return _stale(chain, block, margin).groupBy(utc_date(F.col("ntime")).alias("date")).agg(F.count("*").alias("orphan_blocks"))


def orphans_of_both_arms(chain: DataFrame, captured: DataFrame, block: DataFrame, utc_date, margin: int = 7200) -> DataFrame:
    """orphans_by_day with captured(block_hash, height), orphans of a tail that are deep enough to be final.

    A captured block has no time of its own here: it counts on the date of the canonical block at its height. A block
    that both know counts once, by its own date.
    """
    own = _stale(chain, block, margin).select("block_hash", utc_date(F.col("ntime")).alias("date"))
    canonical = block.select(F.concat(F.lit("B"), F.col("height").cast("string")).alias("block_hash"))
    late = captured.select("block_hash", "height").distinct().join(canonical, "block_hash", "left_anti").join(own, "block_hash", "left_anti")
    both = own.unionByName(late.join(block.where("ntime <> 0").select("height", "date"), "height").select("block_hash", "date"))
    return both.groupBy("date").agg(F.count("*").alias("orphan_blocks"))


COUNTS = (
    "tx_count", "coinstake", "coinbase", "payment", "volume", "stake_volume", "unique_stakers", "blocks", "tx_bytes", "orphan_blocks", "active_addresses", "new_addresses", "sapling_txs",
    "interval_p95_secs", "interval_max_secs", "top10_blocks", "fees_total", "normal_tx_bytes", "rewards_total", "staker_rewards_total", "p2cs_created", "p2cs_spent", "coldstake_txs",
)


def daily_series(L, utc_date) -> DataFrame:
    """The 25 columns per date: dates with transactions or orphans; what a date lacks is 0."""
    from .joins import credits, resolve

    ptx = per_transaction(L.tx, L.out, resolve(L.spends, L.made.where("height >= 0")), 1500)
    credit = credits(L.out, L.tx.join(L.block.select("height", "date"), "height"))
    spine = day_sums(ptx, L.block).join(orphans_by_day(L.chain, L.block, utc_date), "date", "full")
    extra = (difficulty_by_day(L.block), stakers_by_day(L.tx, L.out, L.block), interval_stats_by_day(L.block), active_by_day(credit, L.block), new_by_day(credit, L.block))
    days = reduce(lambda a, b: a.join(b, "date", "left"), extra, spine)
    return days.select("date", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS), *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("avg_difficulty", "coin_days_destroyed")))


def chain_series(L, utc_date) -> DataFrame:
    """daily_series' columns of the chain itself: sizes come from counts of inputs and outputs, so no input is resolved."""
    n = lambda rows, size: rows.groupBy("height").agg((F.count("*") * size).alias("bytes"))
    sized = n(L.made, 34).unionByName(n(L.spends, 150)).unionByName(L.block.select("height", (F.col("n_tx") * 100).alias("bytes")))
    sizes = sized.join(L.block.select("height", "date"), "height").groupBy("date").agg(F.sum("bytes").alias("tx_bytes"))
    spine = sizes.join(orphans_by_day(L.chain, L.block, utc_date), "date", "full")
    days = spine.join(difficulty_by_day(L.block), "date", "left").join(interval_stats_by_day(L.block), "date", "left")
    counts = ("blocks", "tx_bytes", "orphan_blocks", "interval_p95_secs", "interval_max_secs")
    return days.select("date", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("avg_difficulty", F.lit(0.0)).alias("avg_difficulty"))


def complete_days(daily: DataFrame, tip_date: DataFrame, last: int, minimum: int, slice_first: bool = True) -> DataFrame:
    """The last `last` dates without the tip's and without trailing dates of fewer than `minimum` blocks.

    slice_first takes the last dates before it trims, else after; interior gaps stay. One row per day, so an
    order over all of them is small.
    """

    def newest(df: DataFrame) -> DataFrame:
        return df.join(df.select("date").orderBy(F.desc("date")).limit(last), "date", "left_semi")

    def trimmed(df: DataFrame) -> DataFrame:
        open_ = df.join(F.broadcast(tip_date.select(F.col("date").alias("_tip"))), F.col("date") == F.col("_tip"), "left_anti")
        end = open_.where(F.col("blocks") >= minimum).agg(F.max("date").alias("_end"))
        return open_.join(F.broadcast(end), F.col("date") <= F.col("_end")).drop("_end")  # end is one row

    return trimmed(newest(daily)) if slice_first else newest(trimmed(daily))
