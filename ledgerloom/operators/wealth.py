"""Wealth snapshots: rich list, shares, histogram, Gini and Nakamoto coefficients, coin-age bands.

Ranks over all holders never come from a window over all rows. Equal balances are counted first; the
distinct balances fall into a fixed number of ranges whose totals, a few hundred rows, give each range its
offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import COIN, div
from ..sources.ledger import wide

# Lower bounds of the balance histogram in coins.
DECADES = (0, 1, 10, 100, 1_000, 10_000, 100_000)


def holders(totals: DataFrame) -> DataFrame:
    return totals.where("balance > 0").select("address", "balance")


def rich_list(totals: DataFrame, keep: int = 1000) -> DataFrame:
    """(rank, address, balance) of the largest holders: each partition keeps its top rows, and one task merges those."""
    top = holders(totals).orderBy(F.desc("balance"), "address").limit(max(1, min(keep, 1000)))
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("balance"), "address")))  # 1000 rows at most


def top_shares(totals: DataFrame) -> DataFrame:
    """One row: holders, total and the sums of the top 10, 50, 100 and 1000, exact beyond 64 bits."""
    all_ = holders(totals).agg(F.count("*").alias("holders"), F.coalesce(wide("balance"), F.lit(0)).cast("decimal(38,0)").alias("total"))
    s = lambda n: F.coalesce(wide(F.when(F.col("rank") <= n, F.col("balance"))), F.lit(0)).cast("decimal(38,0)").alias(f"top{n}")
    return all_.crossJoin(rich_list(totals).agg(s(10), s(50), s(100), s(1000)))  # one row each


def by_value(totals: DataFrame) -> DataFrame:
    """(x, c): how many holders have each balance, with `span`, a range number that grows with x (64 for each doubling)."""
    g = holders(totals).groupBy(F.col("balance").alias("x")).agg(F.count("*").alias("c"))
    return g.withColumn("span", F.floor(F.log2("x") * 64).cast("int"))


def _offsets(values: DataFrame, descending: bool) -> DataFrame:
    """values with `below` and `sum_before`: holders and wealth in front of each balance in rank order."""
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.col(c))
    spans = values.groupBy("span").agg(F.sum("c").alias("n"), F.sum(F.col("x").cast("decimal(28,0)") * F.col("c").cast("decimal(10,0)")).alias("v"))
    before = W.orderBy(order("span")).rowsBetween(W.unboundedPreceding, -1)  # one row per span, 4096 at most
    spans = spans.select("span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("v").over(before), F.lit(0)).cast("decimal(38,0)").alias("_v"))
    inside = W.partitionBy("span").orderBy(order("x")).rowsBetween(W.unboundedPreceding, -1)
    wealth = F.col("x").cast("decimal(28,0)") * F.col("c").cast("decimal(10,0)")
    return values.join(F.broadcast(spans), "span").select(
        "x", "c", (F.col("_n") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("below"), (F.col("_v") + F.coalesce(F.sum(wealth).over(inside), F.lit(0))).cast("decimal(38,0)").alias("sum_before")
    )


def gini(totals: DataFrame) -> DataFrame:
    """2 sum(i * x_i) / (n * sum(x)) - (n + 1) / n over ascending ranks; 0 without holders."""
    r = _offsets(by_value(totals), descending=False)
    x, c, below = (F.col(k).cast("decimal(20,0)") for k in ("x", "c", "below"))
    ranks = (c * below + c * (c + 1) / 2).cast("decimal(18,0)")  # the sum of the ranks of equal balances
    g = r.agg(F.sum((ranks * F.col("x").cast("decimal(20,0)")).cast("decimal(38,0)")).cast("double").alias("w"), F.sum("c").cast("double").alias("n"), F.sum(x * F.col("c").cast("decimal(10,0)")).cast("double").alias("s"))
    return g.select(F.coalesce(F.round(2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"), 6), F.lit(0.0)).alias("gini"))


def nakamoto(totals: DataFrame) -> DataFrame:
    """The fewest holders who have more than half of all; 0 without holders."""
    r = _offsets(by_value(totals), descending=True)
    total = holders(totals).agg(wide("balance").alias("total"))
    j = r.crossJoin(F.broadcast(total))  # total is one row
    x = F.col("x").cast("decimal(20,0)")
    need = F.floor((F.col("total") - 2 * F.col("sum_before")) / (2 * x)) + 1
    hit = j.where(2 * (F.col("sum_before") + x * F.col("c").cast("decimal(10,0)")) > F.col("total"))
    return hit.agg(F.coalesce(F.min(F.col("below") + F.greatest(need, F.lit(1))), F.lit(0)).cast("long").alias("nakamoto"))


def histogram(rows: DataFrame, value: str = "balance") -> DataFrame:
    """(lo_coins, n) for the seven ranges [lo, hi), empty ones too."""
    bucket = F.lit(DECADES[0])
    for d in DECADES[1:]:
        bucket = F.when(F.col(value) >= d * COIN, d).otherwise(bucket)
    n = rows.where(F.col(value) > 0).groupBy(bucket.cast("long").alias("lo_coins")).agg(F.count("*").alias("n"))
    dim = rows.sparkSession.createDataFrame([(d,) for d in DECADES], "lo_coins long")
    return dim.join(n, "lo_coins", "left").select("lo_coins", F.coalesce("n", F.lit(0)).alias("n"))


def hodl_bands(utxo: DataFrame, tip: DataFrame, per_day: int = 1440) -> DataFrame:
    """(band, value): unspent value by age, each output once; sums are exact beyond 64 bits."""
    from ..functions.scalars import hodl_band

    rows = utxo.select("txid", "vout", "value", "height").dropDuplicates(["txid", "vout"]).crossJoin(F.broadcast(tip))  # tip is one row
    return rows.where("height BETWEEN 0 AND tip").groupBy(hodl_band(F.col("tip") - F.col("height"), per_day).alias("band")).agg(wide("value").alias("value"))
