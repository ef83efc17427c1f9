"""The orphan tail: blocks captured beside the chain, their heights, and what became of each.

A captured block's height is its parent's plus one, where the parent is a canonical block or a captured one whose
height is known; a chain of captured blocks is followed by pointer doubling. A block is canonical or orphan by the
canonical map at its height, pending while the map has none, and unresolved when it has been pending for too long.
Each tick looks again at all blocks within `retain` heights of the tip, and at those of unknown height; settled blocks
further below are evicted. Orphans deep enough to be final go to a log of their own first, which keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import discard, written
from .store import Store

CAPTURED = "block_hash string, prev_hash string, seen long"
RECORDS = "block_hash string, prev_hash string, height long, first_seen long, state string"
CHANGES = "tick long, block_hash string, height long, was string, state string"
FINAL = "block_hash string, height long"


def known_heights(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """(block_hash, height) of the records(block_hash, prev_hash, height, state) of unknown height that links give one.

    In each round a record that waits for another takes over that one's parent and adds its distance, so a chain of
    captured blocks takes as many rounds as its length has digits in base two. An unresolved record lends no height.
    """
    lends = records.where("height IS NOT NULL AND state <> 'unresolved'").select("block_hash", "height")
    known = canonical.select("block_hash", "height").unionByName(lends).select(F.col("block_hash").alias("up"), F.col("height").alias("_h")).dropDuplicates(["up"])
    todo = written(records.where("height IS NULL AND state <> 'unresolved' AND prev_hash IS NOT NULL").select("block_hash", F.col("prev_hash").alias("up"), F.lit(1).cast("long").alias("hops")), False)
    found = None
    for _ in range(64):  # enough for any chain; links in a cycle, which hashes can't form, are left to wait
        met = written(todo.join(known, "up", "left"), False)
        done = met.where("_h IS NOT NULL").select("block_hash", (F.col("_h") + F.col("hops")).alias("height"))
        found = done if found is None else found.unionByName(done)
        known = known.unionByName(done.select(F.col("block_hash").alias("up"), F.col("height").alias("_h")))
        # A block whose parent waits takes over that one's parent; one whose parent nobody knows waits for a later tick.
        above = met.select(F.col("block_hash").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("_h").isNotNull().alias("_known"))
        step = met.where("_h IS NULL").drop("_h").join(above, "up")
        over = F.when(F.col("_known"), F.col("up")).otherwise(F.col("_up")).alias("up")
        todo = written(step.select("block_hash", over, F.when(F.col("_known"), F.col("hops")).otherwise(F.col("hops") + F.col("_hops")).alias("hops")), False)
        if todo.isEmpty():
            break
    return found


class OrphanTail:
    """Records of captured blocks under `root`, one commit a tick."""

    def __init__(self, spark: SparkSession, root: str, retain: int = 300, settle: int = 100, patience: int = 600, **store) -> None:
        self.spark, self.store = spark, Store(spark, root, **store)
        self.retain, self.settle, self.patience = retain, settle, patience

    def table(self, name: str) -> DataFrame:
        return self.store.rows(self.store.read().runs(name), {"records": RECORDS, "changes": CHANGES, "orphans": FINAL}[name])

    def tick(self, captured: DataFrame | None, canonical: DataFrame, now: int) -> None:
        """Take in captured(block_hash, prev_hash, seen) and look again; canonical(height, block_hash) is the map as it is.

        A block captured again changes nothing. now is the clock in seconds, that `seen` is in too.
        """
        was = self.store.read()
        old = self.store.rows(was.runs("records"), RECORDS)
        tip = canonical.agg(F.max("height")).first()[0]
        tip = -1 if tip is None else tip
        everything = old.withColumn("_was", F.col("state"))
        if captured is not None:
            first = captured.groupBy("block_hash").agg(F.min_by("prev_hash", "seen").alias("prev_hash"), F.min("seen").alias("first_seen"))
            fresh = first.join(old.select("block_hash"), "block_hash", "left_anti")
            fresh = fresh.select("block_hash", "prev_hash", F.lit(None).cast("long").alias("height"), "first_seen", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("_was"))
            everything = everything.unionByName(fresh)
        # Heights that are known first, as a block that the map settles lends its height to those that wait for it.
        names = canonical.select(F.col("height").alias("_at"), F.col("block_hash").alias("_name"))
        aged = (F.lit(now) - F.col("first_seen")) > self.patience
        waiting = F.when((F.col("state") == "unresolved") | aged, "unresolved").otherwise("pending")
        settled = F.when(F.col("_name") == F.col("block_hash"), "canonical").when(F.col("_name").isNotNull(), "orphan")
        near = everything.join(names, F.col("height") == F.col("_at"), "left")
        near = near.withColumn("state", F.when(F.col("height") >= tip - self.retain, F.coalesce(settled, waiting)).otherwise(F.col("state"))).drop("_at", "_name")
        near = written(near, False)
        given = known_heights(near, canonical).withColumnRenamed("height", "_at")
        rows = near.join(given, "block_hash", "left").join(names, "_at", "left")
        first_look = F.when(F.col("height").isNotNull(), F.col("state")).when(F.col("_at").isNotNull(), F.coalesce(settled, F.lit("pending"))).otherwise(waiting)
        rows = written(rows.select("block_hash", "prev_hash", F.coalesce("height", "_at").alias("height"), "first_seen", first_look.alias("state"), "_was"), False)
        changed = rows.where("NOT (state <=> _was)").select(F.lit(was.version + 1).cast("long").alias("tick"), "block_hash", "height", F.col("_was").alias("was"), "state")
        logged = self.store.rows(was.runs("orphans"), FINAL).select("block_hash")
        final = rows.where(F.col("height") <= tip - self.settle).where("state = 'orphan'").select("block_hash", "height").join(logged, "block_hash", "left_anti")
        kept = rows.where((F.col("state") == "pending") | (F.col("height") >= tip - self.retain))
        n = was.version + 1
        self.store.commit(was, tip, {
            "records": self.store.write(kept.select(*(c.split()[0] for c in RECORDS.split(", "))), n, n),
            "changes": self.store.merged(was.runs("changes") + self.store.write(changed, n, n), CHANGES),
            "orphans": self.store.merged(was.runs("orphans") + self.store.write(final, n, n), FINAL),
        })
        discard(near, rows)

    def orphans(self, canonical: DataFrame) -> DataFrame:
        """Captured blocks whose height the map gives to another: read from the map and not from the stored state."""
        return self.table("records").select("block_hash", "prev_hash", "height", "first_seen").join(canonical.select("height", F.col("block_hash").alias("_name")), "height").where("block_hash <> _name").drop("_name")

    def follow(self, captured: DataFrame, canonical, checkpoint: str, every: str = "30 seconds"):
        """A started query that ticks with each batch of a captured stream, and by the clock while none comes.

        canonical() gives the map as it is at a tick. A clock of one row a second makes batches of no blocks.
        """
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        none = clock.select(*(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CAPTURED.split(", ")), F.unix_timestamp("timestamp").alias("clock"))
        both = captured.select("block_hash", "prev_hash", "seen", F.lit(None).cast("long").alias("clock")).unionByName(none)

        def each(df: DataFrame, _: int) -> None:
            now = df.agg(F.coalesce(F.max("clock"), F.unix_timestamp())).first()[0]
            self.tick(df.where("block_hash IS NOT NULL").select("block_hash", "prev_hash", "seen"), canonical(), now)

        return both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
