"""Wealth kept current from balance changes: rich list, Gini and Nakamoto without a pass over all holders.

Holders lie in ranges by balance, equal ones by address from the last to the first, each a folder of at most `bound` rows with its number of holders, its sum
and its sum of balances times their places in the range. A batch reads the old balances of its addresses from the
buckets that they name, and rewrites only those ranges that somebody leaves or enters; a range that grows beyond the
bound is cut into pieces of half of it. What a report needs of the other ranges stands in the commit.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import discard, written
from .store import Commit, Run, Store, slots_of

BALANCES = "address string, balance long, height long"
RANKS = "address string, x long"


def _placer(bounds: list[tuple[int, str]]):
    """A function of columns (x, address): how many of the ranges' lower bounds, given in order, a holder has reached.

    Bounds are few against holders and looked up by bisection, so the work doesn't grow with their number.
    """
    if not bounds:
        return lambda x, address: F.lit(0)
    lows, names = np.array([b[0] for b in bounds], dtype=np.int64), [b[1] for b in bounds]

    @F.pandas_udf("int")
    def place(x: pd.Series, address: pd.Series) -> pd.Series:
        lo, hi = (np.searchsorted(lows, x.to_numpy(np.int64), side) for side in ("left", "right"))
        tied = np.flatnonzero(lo < hi)  # bounds of the same balance lie by address from the last to the first
        found = lo.astype(np.int32)
        for k in tied:
            a, b, own = lo[k], hi[k], address.iat[k]
            while a < b:
                m = (a + b) // 2
                a, b = (m + 1, b) if names[m] >= own else (a, m)
            found[k] = a
        return pd.Series(found)

    return place


class WealthState:
    """Balances and ranges under `root`. A range's Run has its lower bound and sums in `extra`."""

    def __init__(self, spark: SparkSession, root: str, bound: int = 1_000_000, **store) -> None:
        self.spark, self.store, self.bound = spark, Store(spark, root, **store), bound

    # --- changes

    def _latest(self, runs: list[Run], addresses: DataFrame) -> DataFrame:
        """(address, balance) of those addresses that the state has, as of the greatest height."""
        slots = slots_of(addresses, "address") if any(r.buckets > 1 for r in runs) else None
        rows = self.store.rows(runs, BALANCES, slots).join(addresses, "address", "left_semi")
        return rows.groupBy("address").agg(F.max_by("balance", "height").alias("balance"))

    def apply(self, deltas: DataFrame, lo: int, hi: int) -> None:
        """Add deltas(address, delta) of the heights lo to hi; heights at or below the last ones change nothing."""
        was = self.store.read()
        if hi <= was.watermark:
            return
        if lo <= was.watermark:
            raise ValueError(f"heights {lo} to {hi} begin below {was.watermark}, which is applied already")
        sums = written(deltas.groupBy("address").agg(F.sum(F.col("delta").cast("decimal(28,0)")).alias("delta")).where("delta <> 0"), False)
        old = self._latest(was.runs("balances"), sums.select("address"))
        both = sums.join(old, "address", "left").select("address", F.coalesce("balance", F.lit(0)).alias("old"), (F.coalesce("balance", F.lit(0)) + F.col("delta")).cast("long").alias("new"))
        moved = written(both, False)
        made = self.store.write(moved.select("address", F.col("new").alias("balance"), F.lit(hi).cast("long").alias("height")), lo, hi, "address")
        # Runs are merged by forget() only: merging keeps an address's last balance, and a rewind needs those before.
        self.store.commit(was, hi, {"balances": was.runs("balances") + made, "ranks": self._moved(was, moved)})
        discard(sums, moved)

    def forget(self, height: int) -> None:
        """Merge the balances of heights up to `height`, below which no rewind goes any more: one row an address."""
        was = self.store.read()
        old = [r for r in was.runs("balances") if r.hi <= height]
        if len(old) < 2:
            return
        rows = self.store.rows(old, BALANCES).groupBy("address").agg(F.max_by("balance", "height").alias("balance"), F.max("height").alias("height"))
        made = self.store.write(rows.select("address", "balance", "height"), old[0].lo, max(r.hi for r in old), "address")
        self.store.commit(was, was.watermark, {"balances": made + [r for r in was.runs("balances") if r.hi > height]})

    def rewind(self, height: int) -> None:
        """Balances as they were at a height at which a batch ended, or at a lower one within a batch: that batch goes too."""
        was = self.store.read()
        gone = [r for r in was.runs("balances") if r.hi > height]
        if not gone:
            return
        kept = [r for r in was.runs("balances") if r.hi <= height]
        touched = written(self.store.rows(gone, BALANCES).groupBy("address").agg(F.max_by("balance", "height").alias("old")), False)
        before = self._latest(kept, touched.select("address"))
        moved = written(touched.join(before, "address", "left").select("address", "old", F.coalesce("balance", F.lit(0)).alias("new")), False)
        self.store.commit(was, min(r.lo for r in gone) - 1, {"balances": kept, "ranks": self._moved(was, moved)})
        discard(touched, moved)

    def _moved(self, was: Commit, moved: DataFrame) -> list[Run]:
        """The ranges after moved(address, old, new); a balance of 0 or less is in none."""
        ranges = was.runs("ranks")
        at = _placer([(r.extra["x"], r.extra["address"]) for r in ranges[1:]])
        placed = lambda x: moved.where(F.col(x) > 0).select("address", F.col(x).alias("x")).withColumn("i", at("x", "address"))
        leaving, arriving = written(placed("old"), False), written(placed("new"), False)
        touched = sorted(r[0] for r in leaving.unionByName(arriving).select("i").distinct().collect())  # at most as many as there are ranges
        if not touched:
            return ranges
        rows = arriving
        if ranges:  # all touched ranges are one table: the plan is of the same size however many they are
            stay = self.store.rows_of([ranges[i] for i in touched], RANKS).withColumn("i", at("x", "address"))
            rows = rows.unionByName(stay.join(leaving.select("address"), "address", "left_anti"))
        rows = written(rows, False)
        discard(leaving, arriving)
        size = rows.groupBy("i").agg(F.count("*").alias("n"))
        of = lambda c: rows.join(F.broadcast(size.where(c).select("i")), "i", "left_semi").select("i", "address", "x")  # noqa: E731  a row for each range
        whole = of(F.col("n") <= self.bound).repartition("i").withColumn("piece", F.lit(0).cast("long"))
        # Too large ones are cut where they lie in order: by a row's place in its task, so a piece is at most half full.
        sorted_ = of(F.col("n") > self.bound).repartitionByRange("i", "x", F.desc("address")).sortWithinPartitions("i", "x", F.desc("address"))
        pieces = sorted_.withColumn("piece", F.floor(F.monotonically_increasing_id() / F.lit(max(1, self.bound // 2))) + 1)
        whole = whole.unionByName(pieces)
        path = f"data/{uuid.uuid4().hex}"
        whole.write.partitionBy("i", "piece").parquet(f"{self.store.root}/{path}")
        back = self.spark.read.schema(f"{RANKS}, i int, piece long").parquet(f"{self.store.root}/{path}")
        place = F.row_number().over(W.partitionBy("i", "piece").orderBy("x", F.desc("address")))
        big = lambda c: F.sum(c.cast("decimal(38,0)"))
        stats = back.withColumn("r", place).groupBy("i", "piece").agg(
            F.count("*").alias("n"), big(F.col("x")).alias("v"), big(F.col("r").cast("decimal(12,0)") * F.col("x").cast("decimal(20,0)")).alias("w"), F.max(F.struct((-F.col("x")).alias("less"), "address")).alias("lo")
        )
        made: dict[int, list[Run]] = {}
        for s in sorted(stats.collect(), key=lambda s: (s.lo.less, s.lo.address), reverse=True):
            extra = {"x": -s.lo.less, "address": s.lo.address, "sum": int(s.v), "weighted": int(s.w)}
            made.setdefault(s.i, []).append(Run(f"{path}/i={s.i}/piece={s.piece}", 0, 0, s.n, extra=extra))
        out = []
        for i, r in enumerate(ranges or [None]):
            pieces = made.get(i, []) if i in touched else [r]
            if pieces and r is not None and i in touched:  # the range begins where it began, whoever is its first now
                pieces[0] = replace(pieces[0], extra=pieces[0].extra | {"x": r.extra["x"], "address": r.extra["address"]})
            out += pieces
        discard(rows)
        return out

    # --- reports

    def rows(self, ranges: list[Run]) -> DataFrame:
        return self.store.rows_of(ranges, RANKS).select("address", F.col("x").alias("balance"))

    def ranges(self) -> list[Run]:
        return self.store.read().runs("ranks")

    def rich_list(self, keep: int = 1000) -> DataFrame:
        """(rank, address, balance) of the largest: only the topmost ranges are read."""
        top, n = [], 0
        for r in reversed(self.ranges()):
            if n >= keep:
                break
            top, n = [*top, r], n + r.rows
        most = self.rows(top).orderBy(F.desc("balance"), "address").limit(keep)
        return most.withColumn("rank", F.row_number().over(W.orderBy(F.desc("balance"), "address")))  # `keep` rows

    def totals(self) -> tuple[int, int]:
        """(holders, sum of their balances)."""
        return sum(r.rows for r in self.ranges()), sum(r.extra["sum"] for r in self.ranges())

    def gini(self) -> float:
        """From the ranges' sums alone: a place is the place within the range and the holders below it."""
        n, total = self.totals()
        below = weighted = 0
        for r in self.ranges():
            weighted += r.extra["weighted"] + below * r.extra["sum"]
            below += r.rows
        return round(2.0 * weighted / (float(n) * float(total)) - (n + 1.0) / n, 6) if n else 0.0

    def nakamoto(self) -> int:
        """The fewest holders with more than half of all: sums down to the range that holds the answer, and its rows."""
        total, above, count = self.totals()[1], 0, 0
        whole = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")  # noqa: E731  an int of Python reaches Spark as 64 bits only
        for r in reversed(self.ranges()):
            if 2 * (above + r.extra["sum"]) > total:
                run = F.sum(F.col("balance").cast("decimal(38,0)")).over(W.orderBy(F.desc("balance"), "address"))  # one range, of bounded size
                k = F.row_number().over(W.orderBy(F.desc("balance"), "address"))
                rows = self.rows([r]).select(k.alias("k"), run.alias("s"))
                return count + rows.where(2 * (F.col("s") + whole(above)) > whole(total)).agg(F.min("k")).first()[0]
            above, count = above + r.extra["sum"], count + r.rows
        return 0
