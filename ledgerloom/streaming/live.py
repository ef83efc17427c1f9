"""Columns of the live series, comparison of two series, and windowed streams of samples and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import daily as D

ADDITIVE = (
    "tx_count", "tx_bytes", "sapling_txs", "coinbase", "coinstake", "payment", "volume", "stake_volume", "coldstake_txs",
    "fees_total", "normal_tx_bytes", "rewards_total", "staker_rewards_total", "p2cs_created", "p2cs_spent", "coin_days_destroyed",
)

#: Columns that don't add up over batches: they are recomputed for the dates of a window.
WINDOWED = ("blocks", "avg_difficulty", "unique_stakers", "top10_blocks", "active_addresses", "new_addresses", "orphan_blocks", "interval_p95_secs", "interval_max_secs")

#: Upper bounds of the counts that quantiles of a metric are read from.
BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500)


def day_deltas(ptx: DataFrame, block: DataFrame) -> DataFrame:
    return D.day_sums(ptx, block).select("date", *ADDITIVE)


def shadow_diff(a: DataFrame, b: DataFrame, columns: tuple[str, ...], relative: float = 1e-9) -> DataFrame:
    """(date, field, a, b) where two daily tables differ; dates of either side count."""
    j = a.select("date", F.struct(*(F.col(c).cast("double").alias(c) for c in columns)).alias("x")).join(b.select("date", F.struct(*(F.col(c).cast("double").alias(c) for c in columns)).alias("y")), "date", "full")
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"x.{c}").alias("a"), F.col(f"y.{c}").alias("b")) for c in columns))
    rows = j.select("date", F.explode(fields).alias("f")).select("date", "f.*")
    near = F.abs(F.col("a") - F.col("b")) <= relative * F.greatest(F.abs("a"), F.abs("b"), F.lit(1.0))
    return rows.where(F.col("a").isNull() | F.col("b").isNull() | ~near)


def tail_state(block_hash, canonical_hash) -> Column:
    """canonical if the map has this hash at the height, orphan if another, pending if none."""
    return F.when(canonical_hash.isNull(), "pending").when(canonical_hash == block_hash, "canonical").otherwise("orphan")


def hourly(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Count and last value of each hour of a stream or table of events(ts, value)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return e.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.max_by("value", "ts").alias("last_value")).select(F.unix_timestamp("window.start").alias("hour"), "n", "last_value")


def alert_windows(metrics: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Five-minute windows every 30 seconds of metrics(ts, event_type, value): count, sum and rate a second."""
    m = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    g = m.groupBy(F.window("ts", "5 minutes", "30 seconds"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), F.round(F.col("n") / 300.0, 6).alias("rate"))


def recompute_due(enabled, dirty, tip, last, interval) -> Column:
    return enabled & ~dirty & (tip >= 0) & ((last < 0) | (tip - last >= interval))


def first_seen(snapshots: DataFrame, key: str, step: int = 3600) -> DataFrame:
    """snapshots(key, hour), distinct, with first_seen: the start of the unbroken run of snapshots that hold the entry.

    An entry that leaves and comes back starts anew. A key has at most one row for each snapshot.
    """
    by_key = W.partitionBy(key).orderBy("hour")
    runs = snapshots.withColumn("_run", F.col("hour") - step * F.row_number().over(by_key))
    return runs.withColumn("first_seen", F.min("hour").over(W.partitionBy(key, "_run"))).drop("_run")


def frozen_tips(block: DataFrame, limit: int = 1200) -> DataFrame:
    """(height, age, minutes) of blocks after which no other came for more than `limit` seconds."""
    gaps = D.block_intervals(block).where(F.col("interval") > limit)
    return gaps.select((F.col("height") - 1).alias("height"), F.col("interval").alias("age"), F.call_function("div", F.col("interval"), F.lit(60)).alias("minutes"))


def bucket_quantiles(metrics: DataFrame, q: float, bounds: tuple = BOUNDS, lateness: str = "1 minute") -> DataFrame:
    """Five-minute windows every 30 seconds of metrics(ts, event_type, value) with n and a quantile, p95 by name.

    Counts below fixed bounds add up over tasks and batches; within a bound's range values are taken as evenly spread,
    and beyond the last bound the bound itself is given. Null values don't count. A table is counted by 30 seconds
    first, so that what is dealt to windows, ten rows for each, are these counts and not the metrics.
    """
    m = metrics.where("value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    by = [F.count("*").alias("n"), *(F.count(F.when(F.col("value") <= b, 1)).alias(f"c{i}") for i, b in enumerate(bounds))]
    if metrics.isStreaming:
        m = m.withWatermark("ts", lateness)
    else:
        m = m.groupBy(F.window("ts", "30 seconds")["start"].alias("ts"), "event_type").agg(*by)
        by = [F.sum(c).alias(c) for c in ("n", *(f"c{i}" for i in range(len(bounds))))]
    g = m.groupBy(F.window("ts", "5 minutes", "30 seconds"), "event_type").agg(*by)
    rank, value = F.lit(q) * F.col("n"), F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        lo, under = (float(bounds[i - 1]), F.col(f"c{i - 1}")) if i else (0.0, F.lit(0))
        value = F.when(F.col(f"c{i}") >= rank, F.lit(lo) + F.lit(float(bounds[i]) - lo) * (rank - under) / (F.col(f"c{i}") - under)).otherwise(value)
    return g.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", value.alias("p95"))


def held_for(levels: DataFrame, seconds: int, step: int = 30) -> DataFrame:
    """(event_type, at): evaluations at which every one of the last `seconds` is in levels(event_type, start), one row each."""
    marks = levels.select("event_type", F.explode(F.sequence("start", F.col("start") + seconds, F.lit(step).cast("long"))).alias("at"))
    return marks.groupBy("event_type", "at").agg(F.count("*").alias("_n")).where(F.col("_n") == seconds // step + 1).drop("_n")


def stalls(metrics: DataFrame, seconds: int) -> DataFrame:
    """(event_type, since, until): neighbours in time of one type at least `seconds` apart.

    Neighbours are found within a type's day, and across days from one row for each type and day.
    """
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = metrics.where("ts IS NOT NULL").select("event_type", t.alias("t")).distinct().withColumn("day", F.floor(F.col("t") / 86400))
    ends = e.groupBy("event_type", "day").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    inner = e.select("event_type", F.col("t").alias("since"), F.lead("t").over(W.partitionBy("event_type", "day").orderBy("t")).alias("until"))
    outer = ends.select("event_type", F.col("hi").alias("since"), F.lead("lo").over(W.partitionBy("event_type").orderBy("day")).alias("until"))
    return inner.unionByName(outer).where(F.col("until") - F.col("since") >= seconds)
