"""Governance operators: passing gates, budget allocation, statuses and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import written

CAP = 432_000


def passing(yeas: Column, nays: Column, enabled: Column, legacy: bool = False) -> Column:
    net = yeas - nays
    return net >= F.ceil(enabled * 0.1) if legacy else net * 10 > enabled


def _sum_up_to(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with `name`: the sum of value over the cycle's rows up to this one, by net descending and proposal_id.

    Rows are summed within (cycle, net, block of ids) and offset by the sums of what comes before, so that no task
    holds a cycle: the window over a cycle has one row for each pair of net votes and block.
    """
    cells = rows.withColumn("_block", F.shiftright("proposal_id", 16))
    keys = ["cycle", "net", "_block"]
    sums = cells.groupBy(*keys).agg(F.sum(value).alias("_all"))
    earlier = W.partitionBy("cycle").orderBy(F.desc("net"), "_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all")
    within = F.sum(value).over(W.partitionBy(*keys).orderBy("proposal_id").rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumn("_here", within).join(sums, keys).withColumn(name, (F.col("_before") + F.col("_here")).cast("long")).drop("_block", "_before", "_here")


def allocate(proposals: DataFrame, cap: int = CAP) -> DataFrame:
    """proposals(cycle, proposal_id, net, amount, eligible) with outcome and spent_before.

    In each cycle, by net votes descending and then proposal_id, an eligible proposal is funded if it still fits;
    smaller ones after a cut may. In each round all cycles fund the longest run of open proposals that fits, and those
    greater than what is left are cut; the first that didn't fit is among them. A null or negative amount counts as 0,
    a null eligible as false; a proposal_id is unique within its cycle.
    """
    amount = F.greatest(F.coalesce("amount", F.lit(0)), F.lit(0)).cast("long")
    rows = written(proposals.select("cycle", F.col("proposal_id").cast("long").alias("proposal_id"), "net", amount.alias("amount"), F.coalesce("eligible", F.lit(False)).alias("eligible")), False)
    left = rows.groupBy("cycle").agg(F.lit(cap).cast("long").alias("left"))
    open_, funded = rows.where("eligible").drop("eligible"), None
    while True:
        fitting = written(_sum_up_to(open_.join(left, "cycle").where("amount <= left"), "amount", "_sum"), False)
        if fitting.isEmpty():
            break
        won = fitting.where("_sum <= left").select("cycle", "proposal_id", "amount")
        funded = won if funded is None else funded.unionByName(won)
        spent = won.groupBy("cycle").agg(F.sum("amount").alias("_spent"))
        left = written(left.join(spent, "cycle", "left").select("cycle", (F.col("left") - F.coalesce("_spent", F.lit(0))).alias("left")), False)
        open_ = fitting.where("_sum > left").drop("_sum", "left")
    paid = rows.withColumn("_paid", F.lit(0).cast("long")) if funded is None else rows.join(funded.select("cycle", "proposal_id", F.col("amount").alias("_paid")), ["cycle", "proposal_id"], "left")
    outcome = F.when(~F.col("eligible"), "belowgate").when(F.col("_paid").isNotNull(), "funded").otherwise("cut")
    if funded is None:
        outcome = F.when(F.col("eligible"), "cut").otherwise("belowgate")
    done = _sum_up_to(paid.withColumn("outcome", outcome).withColumn("_paid", F.coalesce("_paid", F.lit(0))), "_paid", "_sum")
    return done.select("cycle", "proposal_id", "outcome", (F.col("_sum") - F.col("_paid")).cast("long").alias("spent_before"))


def selection_delta(selected: DataFrame, funded: DataFrame) -> DataFrame:
    """(cycle, added, removed): proposals only selected, and only funded."""
    mark = lambda df, name: df.select("cycle", "proposal_id").distinct().withColumn(name, F.lit(1))
    both = mark(selected, "_a").join(mark(funded, "_b"), ["cycle", "proposal_id"], "full").where("_a IS NULL OR _b IS NULL")
    return both.groupBy("cycle").agg(F.count("_a").alias("added"), F.count("_b").alias("removed"))


def status(tip: Column, block_end: Column, passes: Column, funded: Column, valid: Column) -> Column:
    return F.when(~valid, "invalid").when(tip >= block_end, "completed").when(~passes, "failing").when(funded, "passing").otherwise("passing-unfunded")


def tally(votes: DataFrame) -> DataFrame:
    """(proposal_id, yes, no, abstain) of valid votes."""
    n = lambda v: F.count(F.when(F.col("vote") == v, 1)).alias(v.lower())
    return votes.where("valid").groupBy("proposal_id").agg(n("YES"), n("NO"), n("ABSTAIN"))


def approval_curve(votes: DataFrame) -> DataFrame:
    sign = F.when(F.col("vote") == "YES", 1).when(F.col("vote") == "NO", -1).otherwise(0)
    run = W.partitionBy("proposal_id").orderBy("time", "vote_id").rowsBetween(W.unboundedPreceding, 0)
    return votes.where("valid").select("proposal_id", "vote_id", "time", F.sum(sign).over(run).alias("net"))


def vote_shares(tallied: DataFrame) -> DataFrame:
    n = F.col("yes") + F.col("no")
    share = lambda c: F.when(n > 0, F.round(F.col(c) * 100.0 / n, 6)).otherwise(0.0)
    return tallied.select("proposal_id", share("yes").alias("yes_share"), share("no").alias("no_share"))
