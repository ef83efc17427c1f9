"""The live lane: the whole daily series kept current by batches of blocks, with rewind.

A batch brings its transactions with their inputs and outputs, and reads nothing of the ledger beside headers. What
it needs of the past is the lane's own state: outputs by outpoint, first days by address, and who staked and who was
paid on the last days. It reads those buckets only that the batch names. All tables change in one commit.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import daily as D
from ..operators import joins as J
from ..plans.scratch import discard, written
from ..sources.ledger import utc_date
from .live import ADDITIVE, WINDOWED, day_deltas
from .store import Commit, Store, cut, slots_of

DAILY = "date string, " + ", ".join(f"{c} {'double' if c == 'coin_days_destroyed' else 'long'}" for c in ADDITIVE)
WINDOW = "date string, " + ", ".join(f"{c} {'double' if c == 'avg_difficulty' else 'long'}" for c in WINDOWED)
TREASURY = "height long, date string, total_paid long, n_outputs long"
SEEN = "address string, date string, height long"
FACTS = "height long, date string, kind string, name string"


def feed(tx: DataFrame, inp: DataFrame, out: DataFrame) -> DataFrame:
    """Transactions with their inputs and outputs, as a stream of blocks brings them."""
    outs = out.groupBy("txid").agg(F.collect_list(F.struct("vout", "value", "kind", "addr_a", "addr_b")).alias("outs"))
    ins = inp.groupBy("txid").agg(F.collect_list(F.struct("prev_txid", "prev_vout")).alias("ins"))
    return tx.select("txid", "height", "ty", "value_balance").join(outs, "txid", "left").join(ins, "txid", "left")


def feed_by_height(tx: DataFrame, spends: DataFrame, made: DataFrame) -> DataFrame:
    """feed of inputs and outputs that carry their transaction's height, dealt to ranges of heights: each row moves once.

    A side without rows is an empty array.
    """
    none = lambda t: F.lit(None).cast(t)
    one, two, three = F.struct("ty", "value_balance"), F.struct("vout", "value", "kind", "addr_a", "addr_b"), F.struct("prev_txid", "prev_vout")
    types = [df.select(s.alias("s")).schema["s"].dataType for df, s in ((tx, one), (made, two), (spends, three))]
    row = lambda df, *parts: df.select("height", "txid", *(F.coalesce(none(t), p).alias(n) if p is not None else none(t).alias(n) for n, t, p in zip(("t", "o", "i"), types, parts)))
    rows = row(tx, one, None, None).unionByName(row(made, None, two, None)).unionByName(row(spends, None, None, three))
    each = rows.repartitionByRange("height").groupBy("height", "txid").agg(F.first("t", True).alias("t"), F.collect_list("o").alias("outs"), F.collect_list("i").alias("ins"))
    return each.where("t IS NOT NULL").select("txid", "height", "t.ty", "t.value_balance", "outs", "ins").sortWithinPartitions("height")


#: A batch of fewer rows than this asks for its part of the state by a broadcast of its keys.
FEW = 500_000


class Outpoints:
    """Outputs keyed by the transaction's id: what a batch's inputs spend is read from the buckets that they name."""

    def __init__(self, store: Store, id_type: str = "long") -> None:
        self.store = store
        self.schema = f"txid {id_type}, vout int, value long, kind int, addr_a string, addr_b string, height long"

    def lookup(self, runs: list, keys: DataFrame) -> DataFrame:
        """The outputs in the buckets that keys(txid) fall in: all that the keys name, and some more."""
        slots = slots_of(keys, "txid") if any(r.buckets > 1 for r in runs) else None
        return self.store.rows(runs, self.schema, slots)

    def resolve(self, runs: list, ins: DataFrame, outs: DataFrame, n: int | None = None) -> DataFrame:
        """Inputs (txid, prev_txid, prev_vout) with what they spend, of the state or of the batch's own outputs.

        Where there are few inputs, n, the state is cut down to what they name before it is moved.
        """
        keys = ins.select(F.col("prev_txid").alias("txid"))
        known = self.lookup(runs, keys)
        if runs and n is not None and n < FEW:
            known = known.join(F.broadcast(keys.distinct()), "txid", "left_semi")
        return J.resolve(ins, known.unionByName(outs.select(*known.columns)))

    def add(self, runs: list, outs: DataFrame, lo: int, hi: int, n: int) -> list:
        made = self.store.write(outs.select(*(c.split()[0] for c in self.schema.split(", "))), lo, hi, "txid", n=n)
        return self.store.merged(runs + made, self.schema, "txid")


class FirstSeen:
    """The first day of each address; a row for each time that an earlier day came in at a greater height."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def days(self, runs: list, addresses: DataFrame, n: int | None = None) -> DataFrame:
        """(address, first) of those of addresses(address), n rows at most if that is known, that the state has."""
        slots = slots_of(addresses, "address") if any(r.buckets > 1 for r in runs) else None
        asked = addresses.distinct()
        rows = self.store.rows(runs, SEEN, slots).join(F.broadcast(asked) if n is not None and n < FEW else asked, "address", "left_semi")
        return rows.groupBy("address").agg(F.min("date").alias("first"))

    def add(self, runs: list, paid: DataFrame, lo: int, hi: int, n: int) -> list:
        """With the days of paid(address, date, height) that are earlier than what is known."""
        by = paid.groupBy("address", "date").agg(F.min("height").alias("height"))
        before = F.min("date").over(W.partitionBy("address").orderBy("height", "date").rowsBetween(W.unboundedPreceding, -1))
        own = by.withColumn("_b", before).where("_b IS NULL OR date < _b").drop("_b")
        if runs:
            known = self.days(runs, own.select("address"), n)
            own = own.join(known, "address", "left").where("first IS NULL OR date < first")
        made = self.store.write(own.select("address", "date", "height"), lo, hi, "address", n=n)
        return self.store.merged(runs + made, SEEN, "address")


class Lane:
    """The daily series, treasury payouts and state under `root`.

    every: columns that don't add up are computed again when the watermark passes a multiple of it, and by recompute().
    days: that many days before the newest are computed again then, for side blocks that come late.
    max_reorg: a rewind by more blocks is refused, it asks for a full rebuild; facts of older days are let go.
    """

    def __init__(self, spark: SparkSession, root: str, era_scale: int = 1, days: int = 3, every: int = 60, max_reorg: int = 4320, id_type: str = "long", **store) -> None:
        self.spark, self.store = spark, Store(spark, root, **store)
        self.era_scale, self.back, self.every, self.max_reorg, self.id_type = era_scale, days, every, max_reorg, id_type
        self.outpoints, self.seen = Outpoints(self.store, id_type), FirstSeen(self.store)
        self.feed_schema = (
            f"txid {id_type}, height long, ty int, value_balance long, outs array<struct<vout:int,value:long,kind:int,addr_a:string,addr_b:string>>, "
            f"ins array<struct<prev_txid:{id_type},prev_vout:int>>"
        )

    # --- reading

    def watermark(self) -> int:
        """The last height up to which every block is whole and applied; -1 at the start."""
        return self.store.read().watermark

    def table(self, name: str, version: int | None = None) -> DataFrame:
        schema = {"daily": DAILY, "window": WINDOW, "treasury": TREASURY, "seen": SEEN, "facts": FACTS, "outpoints": self.outpoints.schema, "waiting": self.feed_schema}[name]
        return self.store.rows(self.store.read(version).runs(name), schema)

    def series(self) -> DataFrame:
        """All columns of each date that has transactions."""
        zero = lambda c: F.lit(0.0 if c == "avg_difficulty" else 0)
        both = self.table("daily").join(self.table("window"), "date", "left")
        return both.select("date", *ADDITIVE, *(F.coalesce(c, zero(c)).alias(c) for c in WINDOWED))

    # --- following

    def apply(self, rows: DataFrame, block: DataFrame, chain: DataFrame) -> None:
        """Add the transactions of `rows` (as of feed) above the watermark; replayed ones change nothing.

        block has the headers of the canonical chain with n_tx, chain all headers that are known. Transactions of
        a block that came in part or after a gap wait in the state for the batch that completes it.
        """
        was = self.store.read()
        mark = was.watermark
        columns = [c.split()[0] for c in ("txid x", "height x", "ty x", "value_balance x", "outs x", "ins x")]
        new = rows.where(F.col("height") > mark).select(*columns)
        if was.runs("waiting"):
            new = new.unionByName(self.store.rows(was.runs("waiting"), self.feed_schema))
        # The date comes with the transaction: outputs and payments need no join by height.
        new = written(new.join(block.where(F.col("height") > mark).select("height", "date"), "height", "left"), False)
        if not new.groupBy("txid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            all_, new = new, written(new.dropDuplicates(["txid"]), False)
            discard(all_)
        size = lambda c: F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)))
        count = new.groupBy("height").agg(F.count("*").alias("_n"), size("outs").alias("_outs"), size("ins").alias("_ins"))
        due = block.where(F.col("height") > mark).select("height", "n_tx").join(count, "height", "full")
        short = F.col("n_tx").isNotNull() & (F.coalesce("_n", F.lit(0)) < F.col("n_tx"))
        gap, top, came, outputs, inputs = due.agg(F.min(F.when(short, F.col("height"))), F.max("height"), F.sum("_n"), F.sum("_outs"), F.sum("_ins")).first()
        if not came:
            discard(new)
            return
        reached = max(mark, top if gap is None else gap - 1)
        tables = {"waiting": self.store.write(new.where(F.col("height") > reached).select(*columns), reached + 1, top)}
        if reached > mark:
            tables |= self._advanced(was, new.where(F.col("height") <= reached), block, chain, reached, outputs, inputs)
        self.store.commit(was, reached, tables)
        discard(new)

    def _advanced(self, was: Commit, now: DataFrame, block: DataFrame, chain: DataFrame, reached: int, outputs: int, inputs: int) -> dict:
        """The tables with the batch in them. What doesn't need each other is written at the same time."""
        lo = was.watermark + 1
        outs = now.select("txid", "height", "ty", "date", F.inline("outs")).where("height >= 0")
        # The lowest height whose day's columns are not computed yet.
        open_ = min(lo, max((r.hi for r in was.runs("window")), default=-1) + 1)

        def sums() -> dict:
            ins = now.select("txid", "height", F.inline("ins"))
            ptx = D.per_transaction(now.drop("outs", "ins"), outs, self.outpoints.resolve(was.runs("outpoints"), ins, outs, inputs), self.era_scale)
            ptx = written(ptx.where("date IS NOT NULL"), False)
            old = self.store.rows(was.runs("daily"), DAILY)
            both = old.unionByName(day_deltas(ptx, block)).groupBy("date").agg(*(F.sum(c).cast("double" if c == "coin_days_destroyed" else "long").alias(c) for c in ADDITIVE))
            payouts = D.treasury_payouts(ptx, block).select("height", "date", "total_paid", F.col("n_outputs").cast("long").alias("n_outputs"))
            made = self._together(
                lambda: {"daily": self.store.write(both, 0, reached)},
                lambda: {"treasury": self.store.merged(was.runs("treasury") + self.store.write(payouts, lo, reached), TREASURY)},
            )
            discard(ptx)
            return made

        def people() -> dict:
            dated = outs.where("date IS NOT NULL")
            paid = written(J.paid(dated).select("address", "date", "height").distinct(), False)
            first = dated.where("ty = 1 AND addr_a IS NOT NULL").groupBy("txid", "height", "date").agg(F.min_by("addr_a", "vout").alias("name"))
            won = first.select("height", "date", F.lit("s").alias("kind"), "name")
            facts = won.unionByName(paid.select("height", "date", F.lit("a").alias("kind"), F.col("address").alias("name")))
            made = self._together(
                lambda: {"seen": self.seen.add(was.runs("seen"), paid, lo, reached, 2 * outputs)},
                lambda: {"facts": self._kept(was.runs("facts") + self.store.write(facts, lo, reached, dated=True), block, reached, open_)},
            )
            discard(paid)
            return made

        made = self._together(sums, people, lambda: {"outpoints": self.outpoints.add(was.runs("outpoints"), outs, lo, reached, outputs)})
        if reached // self.every != max(was.watermark, 0) // self.every:
            made["window"] = self._window(was.runs("window"), made, block.where(F.col("height") <= reached), chain, open_, reached)
        return made

    def _together(self, *parts) -> dict:
        """The tables that all parts make, each in a thread of its own: the jobs of a small batch are short and many."""
        with ThreadPoolExecutor(len(parts)) as pool:
            return {name: runs for made in [pool.submit(inheritable_thread_target(self.spark)(p)) for p in parts] for name, runs in made.result().items()}

    def _kept(self, facts: list, block: DataFrame, reached: int, open_: int) -> list:
        """Facts of days that a rewind, the next batches or columns not computed from height open_ on may still ask for."""
        if len(facts) <= self.store.most_runs:
            return facts
        day = F.date_sub(F.min(F.to_date("date")), self.back + 2)
        oldest = block.where(F.col("height").between(min(reached - self.max_reorg, open_ - 1), reached)).agg(F.date_format(day, "yyyy-MM-dd")).first()[0]
        return self.store.merged([r for r in facts if r.last is None or r.last >= oldest], FACTS, dated=True)

    def _window(self, window: list, made: dict, block: DataFrame, chain: DataFrame, lo: int, reached: int) -> list:
        """Columns that don't add up, computed again from the last days before height lo on, to `reached`.

        Side blocks up to two hours older than the tip did not count when those days were computed last.
        """
        day = F.to_date("date")
        start = block.agg(F.date_format(F.date_sub(F.min(F.when(F.col("height") >= lo - 1, day)), self.back), "yyyy-MM-dd")).first()[0]
        inside = block.where(F.col("date") >= start)
        facts = self.store.rows([r for r in made["facts"] if r.last is None or r.last >= start], FACTS).where(F.col("date") >= start)
        won = facts.where("kind = 's'").groupBy("date", F.col("name").alias("staker")).agg(F.count("*").alias("n"))
        paid = written(facts.where("kind = 'a'").select("date", F.col("name").alias("address")).distinct(), False)
        active = paid.groupBy("date").agg(F.count("*").alias("active_addresses"))
        first = self.seen.days(made["seen"], paid.select("address"))
        new = first.where(F.col("first") >= start).groupBy(F.col("first").alias("date")).agg(F.count("*").alias("new_addresses"))
        since = F.unix_timestamp(F.lit(start).cast("date").cast("timestamp"))
        orphans = D.orphans_by_day(chain.where(F.col("ntime") >= since), inside, utc_date)
        low = inside.agg(F.min("height")).first()[0]
        intervals = D.interval_stats_by_day(block.where(F.col("height") >= low - 1)).where(F.col("date") >= start)
        days = D.difficulty_by_day(inside)
        for part in (D.winners(won), intervals, active, new, orphans):
            days = days.join(part, "date", "left")
        fresh = days.select("date", *(F.coalesce(c, F.lit(0)).cast("double" if c == "avg_difficulty" else "long").alias(c) for c in WINDOWED))
        kept = self.store.rows(window, WINDOW).where(F.col("date") < start)
        done = self.store.write(kept.unionByName(fresh), reached, reached)
        discard(paid)
        return done

    def recompute(self, block: DataFrame, chain: DataFrame) -> None:
        """Bring the columns that don't add up to the watermark, from the days on that they were last computed at."""
        was = self.store.read()
        if was.watermark < 0:
            return
        lo = max((r.hi for r in was.runs("window")), default=-1) + 1
        made = self._window(was.runs("window"), was.tables, block.where(F.col("height") <= was.watermark), chain, min(lo, was.watermark), was.watermark)
        self.store.commit(was, was.watermark, {"window": made})

    def rewind(self, fork_height: int, block: DataFrame) -> bool:
        """Drop the days from one day before the fork's on, in one commit: series, payouts and state; False asks for a rebuild.

        The next batches bring the heights above the new watermark again, of the new chain. block holds the
        fork's header; whether it has the new chain's headers already does not matter.
        """
        was = self.store.read()
        if was.watermark <= fork_height:
            return True
        if was.watermark - fork_height > self.max_reorg:
            return False
        shared = block.where(F.col("height") <= fork_height)
        since = shared.where(F.col("height") == fork_height).agg(F.date_format(F.date_sub(F.max(F.to_date("date")), 1), "yyyy-MM-dd")).first()[0]
        if since is None:
            raise ValueError(f"no header of the fork's height {fork_height}")
        first = shared.where(F.col("date") >= since).agg(F.min("height")).first()[0]
        # Days that have blocks on both sides of the first height are rebuilt whole too, so it moves down to their start.
        while True:
            dates = shared.where(F.col("height") >= first).select("date").distinct()
            lower = shared.join(dates, "date", "left_semi").agg(F.min("height")).first()[0]
            if lower >= first:
                break
            first = lower
        tables = {name: cut(was.runs(name), first - 1) for name in ("treasury", "outpoints", "seen", "facts")}
        for name, schema in (("daily", DAILY), ("window", WINDOW)):
            left = self.store.rows(was.runs(name), schema).where(F.col("date") < since).join(dates, "date", "left_anti")
            tables[name] = self.store.write(left, first - 1, first - 1)
        self.store.commit(was, first - 1, tables | {"waiting": []})
        return True

    def follow(self, stream: DataFrame, block: DataFrame, chain: DataFrame, checkpoint: str):
        """A started query that applies each micro-batch of a stream of feed rows."""
        each = lambda df, _: self.apply(df, block, chain)
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
