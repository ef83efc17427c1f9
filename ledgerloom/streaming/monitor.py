"""Streams that watch: the mempool by snapshots, a tip that stands still, and alerts that pend, fire and resolve."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.scratch import discard, written
from .store import Store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Mempool:
    """Entries as of the last snapshot, each with the time since which it has been there, and the log of changes.

    Snapshots come as rows (txid, at), a row for each entry; an empty one as a single row without a txid. A batch may
    bring any number of snapshots; those not later than the last one taken in change nothing.
    """

    def __init__(self, spark: SparkSession, root: str, id_type: str = "long", **store) -> None:
        self.spark, self.store = spark, Store(spark, root, **store)
        self.schemas = {"entries": f"txid {id_type}, first_seen long", "changes": f"at long, txid {id_type}, kind string, first_seen long"}

    def table(self, name: str) -> DataFrame:
        return self.store.rows(self.store.read().runs(name), self.schemas[name])

    def apply(self, rows: DataFrame) -> None:
        was = self.store.read()
        new = written(rows.where(F.col("at") > was.watermark).select("txid", "at").distinct(), False)
        polls = new.select("at").distinct().withColumn("k", F.row_number().over(W.orderBy("at")))  # one row a snapshot
        polls = written(polls, False)
        n, last = polls.agg(F.max("k"), F.max("at")).first()
        if n is None:
            discard(new, polls)
            return
        old = self.store.rows(was.runs("entries"), self.schemas["entries"]).select("txid", F.lit(0).alias("k"), F.col("first_seen").alias("at"))
        seen = new.where("txid IS NOT NULL").join(polls, "at").select("txid", "k", "at").unionByName(old)
        # Snapshots in a row that hold an entry are a stay; a stay that goes on from before has number 0 in it.
        run = F.col("k") - F.row_number().over(W.partitionBy("txid").orderBy("k"))
        stays = seen.withColumn("run", run).groupBy("txid", "run").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min_by("at", "k").alias("first_seen"))
        stays = written(stays, False)
        added = stays.where("lo > 0").select(F.col("first_seen").alias("at"), "txid", F.lit("added").alias("kind"), "first_seen")
        gone = stays.withColumn("k", F.col("hi") + 1).join(polls, "k").select("at", "txid", F.lit("removed").alias("kind"), "first_seen")
        lo = was.watermark + 1
        self.store.commit(was, last, {
            "entries": self.store.write(stays.where(F.col("hi") == n).select("txid", "first_seen"), last, last),
            "changes": self.store.merged(was.runs("changes") + self.store.write(added.unionByName(gone), lo, last), self.schemas["changes"]),
        })
        discard(new, polls, stays)

    def follow(self, snapshots: DataFrame, checkpoint: str):
        """A started query that takes in each micro-batch of a stream of snapshots; a snapshot must not span two batches."""
        return snapshots.writeStream.foreachBatch(lambda df, _: self.apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_events(blocks: DataFrame, txs: DataFrame, reorgs: DataFrame, mempool: DataFrame) -> DataFrame:
    """(kind, id, at) of all that a subscriber hears: blocks and reorganisations by hash or height, transactions, and mempool changes."""
    row = lambda df, kind, c, at: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"), F.col(at).cast("long").alias("at"))
    changes = mempool.select(F.concat(F.lit("mempool_"), F.col("kind")).alias("kind"), F.col("txid").cast("string").alias("id"), "at")
    return row(blocks, "block", "height", "ntime").unionByName(row(txs, "tx", "txid", "ntime")).unionByName(row(reorgs, "reorg", "block_hash", "ntime")).unionByName(changes)


class _Watch(StatefulProcessor):
    """One chain's tip; a timer goes off `limit` seconds after its time unless a higher block comes."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tip = handle.getValueState("tip", "height long, ntime long, frozen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = max((r for pdf in rows for r in zip(pdf["height"].tolist(), pdf["ntime"].tolist(), strict=True)), default=None)
        known = self.tip.get() if self.tip.exists() else None
        if best is None or known is not None and best[0] <= known[0]:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if known is not None and known[2]:
            yield self._says(key, best, "cleared", 0)
        now, due = timerValues.getCurrentProcessingTimeInMs(), (best[1] + self.limit) * 1000
        self.tip.update((*best, due <= now))
        if due <= now:  # an old block was the newest to come
            yield self._says(key, best, "frozen", now // 1000 - best[1])
        else:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        height, ntime, frozen = self.tip.get()
        if not frozen:
            self.tip.update((height, ntime, True))
            yield self._says(key, (height, ntime), "frozen", timerValues.getCurrentProcessingTimeInMs() // 1000 - ntime)

    @staticmethod
    def _says(key, tip, state: str, age: int) -> pd.DataFrame:
        return pd.DataFrame({"chain": [key[0]], "height": [tip[0]], "state": [state], "age": [int(age)]})

    def close(self) -> None:
        pass


def watch_tips(blocks: DataFrame, limit: int = 1200) -> DataFrame:
    """(chain, height, state, age) when the tip of blocks(chain, height, ntime), a stream, stands still and when it moves again.

    The alarm comes from the clock: no block has to come for it. It is given once for a tip.
    """
    blocks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return blocks.groupBy("chain").transformWithStateInPandas(_Watch(limit), "chain string, height long, state string, age long", "update", "processingTime")


# --- alerts


def silences(metrics: DataFrame, window: int = 300, step: int = 30) -> DataFrame:
    """(event_type, at): evaluations, multiples of step, with no event from `at` on for a window, between a type's first and last event."""
    from .live import stalls

    gaps = stalls(metrics, window)
    first = (F.floor(F.col("since") / step) + 1) * step
    last = F.floor((F.col("until") - window) / step) * step
    return gaps.where(first <= last).select("event_type", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("at"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(rule, at) with k, their number within the rule: numbers within a day, and days offset from one row a day."""
    day = rows.withColumn("_day", F.floor(F.col("at") / 86400))
    counts = day.groupBy("rule", "_day").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("rule").orderBy("_day")) - F.col("_n")
    inside = F.row_number().over(W.partitionBy("rule", "_day").orderBy("at"))
    return day.withColumn("_r", inside).join(counts.withColumn("_b", before).drop("_n"), ["rule", "_day"]).select("rule", "at", (F.col("_b") + F.col("_r")).alias("k"))


def transitions(holds: DataFrame, seconds: int, last: DataFrame, step: int = 30) -> DataFrame:
    """(rule, at, state): when each rule of holds(rule, at) became pending, firing, resolved or inactive.

    holds has the evaluations at which the rule's condition is true, multiples of step; all others are false, those
    of no data too. A rule fires when it has held for `seconds`; when it ends it is resolved if it had fired, else
    inactive. last is one row with the time of the last evaluation.
    """
    holds = holds.select("rule", "at").distinct()
    moved = lambda by: holds.select("rule", (F.col("at") + by).alias("at"))
    starts = _numbered(holds.join(moved(step), ["rule", "at"], "left_anti"))
    stops = _numbered(holds.join(moved(-step), ["rule", "at"], "left_anti")).withColumnRenamed("at", "stop")
    stays = starts.join(stops, ["rule", "k"]).crossJoin(F.broadcast(last.select(F.col(last.columns[0]).alias("_last"))))  # last is one row
    fired = F.col("stop") - F.col("at") >= seconds
    steps = F.array(
        F.struct(F.col("at").alias("at"), F.lit("pending").alias("state")),
        F.when(fired, F.struct((F.col("at") + seconds).alias("at"), F.lit("firing").alias("state"))),
        F.when(F.col("stop") + step <= F.col("_last"), F.struct((F.col("stop") + step).alias("at"), F.when(fired, "resolved").otherwise("inactive").alias("state"))),
    )
    return stays.select("rule", F.explode(F.array_compact(steps)).alias("s")).select("rule", "s.at", "s.state")


class _Alert(StatefulProcessor):
    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stay = handle.getValueState("stay", "since long, fired boolean, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, fired, seen = self.stay.get() if self.stay.exists() else (None, False, None)
        out = []
        for at, holds in sorted((int(a), bool(h)) for pdf in rows for a, h in zip(pdf["at"], pdf["holds"], strict=True)):
            if seen is not None and at <= seen:
                continue
            seen = at
            if holds and since is None:
                since, fired = at, False
                out.append((at, "pending"))
            if holds and not fired and at - since >= self.seconds:
                fired = True
                out.append((at, "firing"))
            if not holds and since is not None:
                out.append((at, "resolved" if fired else "inactive"))
                since, fired = None, False
        self.stay.update((since, fired, seen))
        if out:
            yield pd.DataFrame({"rule": [key[0]] * len(out), "at": [x[0] for x in out], "state": [x[1] for x in out]})

    def close(self) -> None:
        pass


def alert_states(evaluations: DataFrame, seconds: int) -> DataFrame:
    """transitions as a stream, of evaluations(rule, at, holds) that come in the order of time, true ones and false ones.

    An evaluation not later than the last one of its rule changes nothing.
    """
    evaluations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return evaluations.groupBy("rule").transformWithStateInPandas(_Alert(seconds), "rule string, at long, state string", "update", "none")
