"""Registered ledger queries of the live lane, the orphan tail, forks, the mempool and alert states."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chain as H
from ..operators import daily as D
from ..sources.ledger import Ledger, utc_date
from ..streaming import lane, live, monitor, tail, wealth_state
from .catalog import PLAIN_SQL, credit, debit, ptx, query, tip
from .catalog_pages import _P95, _SEEN, seen
from .scratch import exact, shared_dir, written

# --- J1 to J4: the daily series kept live


@Ledger.view
def blocks_feed(L: Ledger) -> DataFrame:
    """The ledger's transactions as a feed brings them, written in the order of heights."""
    return written(lane.feed_by_height(L.tx, L.spends, L.made), False)


def state_of(L: Ledger, reorg: bool = False, every: int = 1 << 40, **options) -> lane.Lane:
    """The lane after replaying the chain in three batches, the second twice; then, if asked, a rewind and a replay.

    Columns that don't add up are computed every so many blocks only, so by default not at all.
    """
    made = lane.Lane(L.spark, f"{shared_dir(L.spark)}/live/{uuid.uuid4().hex}", 1500, every=every, **options)
    top = tip(L).first().tip
    for a, b in ((0, top // 3), (top // 3, 2 * top // 3), (top // 3, 2 * top // 3), (0, top)):
        made.apply(blocks_feed(L).where(F.col("height").between(a, b)), L.block, L.chain)
    if reorg:
        made.rewind(top - 200, L.block)
        made.apply(blocks_feed(L), L.block, L.chain)
    return made


_DELTAS = "SELECT d1.*, fees_total, normal_tx_bytes, rewards_total, staker_rewards_total, p2cs_created, p2cs_spent FROM d1 JOIN d3 USING (date)"


@query(_DELTAS)
def live_replay(L):
    return state_of(L).table("daily").drop("coin_days_destroyed")


@query(_DELTAS)
def reorg_replay(L):
    return state_of(L, True).table("daily").drop("coin_days_destroyed")


@query("SELECT 0 AS mismatches")
def shadow_validation(L):
    batch = live.day_deltas(ptx(L), L.block)
    return live.shadow_diff(state_of(L).table("daily"), batch, tuple(c for c in live.ADDITIVE if c != "coin_days_destroyed")).agg(F.count("*").cast("int").alias("mismatches"))


_LIVE = f"SELECT date, {', '.join(c for c in (*live.ADDITIVE, *live.WINDOWED) if c != 'coin_days_destroyed')} FROM daily WHERE date IN (SELECT date FROM d1)"


def whole_series(L: Ledger, reorg: bool) -> DataFrame:
    made = state_of(L, reorg, every=60)
    made.recompute(L.block, L.chain)
    return made.series().drop("coin_days_destroyed")


@query(_LIVE)
def live_series(L):
    return whole_series(L, False)


@query(_LIVE)
def live_series_after_reorg(L):
    return whole_series(L, True)


@query("SELECT height, date, treasury AS total_paid, n_outputs FROM ptx JOIN block USING (height) WHERE treasury > 0")
def live_treasury_after_reorg(L):
    """The lane's payouts: those above the fork's day were pruned by the rewind and came again with the replay."""
    return state_of(L, True).table("treasury")


@query("SELECT c.address, min(date) AS first FROM credit c JOIN block USING (height) GROUP BY c.address")
def live_first_days(L):
    """The lane's state of first days, from buckets of few addresses and after a rewind."""
    made = state_of(L, True, rows_a_bucket=20_000)
    return made.seen.days(made.store.read().runs("seen"), made.table("seen").select("address"))


@query("SELECT txid, prev_txid, prev_vout, value, kind, addr_a, addr_b, prev_height FROM joined")
def live_prevouts(L):
    """Every input resolved in batches against the state of outpoints, which each batch reads in part and adds to."""
    made = lane.Lane(L.spark, f"{shared_dir(L.spark)}/live/{uuid.uuid4().hex}", rows_a_bucket=20_000)
    top = tip(L).first().tip
    runs, found = [], None
    for k in range(4):
        lo, hi = (top + 1) * k // 4, (top + 1) * (k + 1) // 4 - 1
        now = blocks_feed(L).where(F.col("height").between(lo, hi))
        outs = now.select("txid", "height", F.inline("outs"))
        part = made.outpoints.resolve(runs, now.select("txid", F.inline("ins")), outs)
        found = part if found is None else found.unionByName(part)
        runs = made.outpoints.add(runs, outs, lo, hi, None)
    return found


# --- J5: the orphan tail

_LAG = 3  # so many of the last captured heights the canonical map doesn't have yet


def tail_of(L: Ledger) -> tail.OrphanTail:
    """The tail after four ticks over all headers as a captured log, each a quarter of the heights, the map behind by a few."""
    made = tail.OrphanTail(L.spark, f"{shared_dir(L.spark)}/tail/{uuid.uuid4().hex}")
    top = tip(L).first().tip
    names = L.block.select("height", F.concat(F.lit("B"), F.col("height").cast("string")).alias("block_hash"))
    for k in range(4):
        lo, hi = (top + 1) * k // 4, (top + 1) * (k + 1) // 4 - 1
        came = L.chain.where(F.col("true_height").between(lo, hi)).select("block_hash", "prev_hash", F.col("ntime").alias("seen"))
        made.tick(came, names.where(F.col("height") <= hi - _LAG), came.agg(F.max("seen")).first()[0])
    return made


# A captured block's height by its links: from parents that the map has, then through captured ones.
_CLAIMED = f""", known AS (SELECT height, block_hash FROM canonical WHERE height <= (SELECT tip FROM tip) - {_LAG}),
claimed AS (
  SELECT c.block_hash, k.height + 1 AS height, c.ntime FROM chain c JOIN known k ON k.block_hash = c.prev_hash
  UNION ALL SELECT c.block_hash, p.height + 1, c.ntime FROM chain c JOIN claimed p ON p.block_hash = c.prev_hash WHERE c.prev_hash NOT IN (SELECT block_hash FROM known)),
-- What a tick leaves pending, as the map is behind, a later one looks at only if it is within 300 of its tip.
passed AS (SELECT (tip + 1) * k // 4 - 1 AS top, (tip + 1) * (k + 1) // 4 - 1 AS next FROM tip, (SELECT unnest([1, 2, 3]) AS k)),
stuck AS (SELECT DISTINCT c.height FROM claimed c JOIN passed p ON c.height > p.top - {_LAG} AND c.height <= p.top AND c.height < p.next - {_LAG} - 300),
judged AS (SELECT c.block_hash, c.height, CASE WHEN k.block_hash IS NULL OR c.height IN (SELECT height FROM stuck) THEN 'pending' WHEN k.block_hash = c.block_hash THEN 'canonical' ELSE 'orphan' END AS state FROM claimed c LEFT JOIN known k USING (height))"""


@query(f"{_CLAIMED} SELECT block_hash, height, state FROM judged WHERE state = 'pending' OR height >= (SELECT max(height) FROM known) - 300")
def orphan_tail_replay(L):
    """What the tail keeps at the end: the last 300 heights under the map's tip, and what waits above it."""
    return tail_of(L).table("records").select("block_hash", "height", "state")


@query(f"{_CLAIMED} SELECT block_hash, height FROM judged WHERE state = 'orphan' AND height <= (SELECT max(height) FROM known) - 100")
def orphan_tail_log(L):
    """The log of captured orphans that are 100 deep: evicted records stay in it."""
    return tail_of(L).table("orphans")


@query(f"""{_CLAIMED}, deep AS (SELECT block_hash, height FROM judged WHERE state = 'orphan' AND height <= (SELECT max(height) FROM known) - 100),
dated AS (SELECT d.block_hash, b.date FROM deep d JOIN block b USING (height)),
early AS (SELECT DISTINCT block_hash, CAST(CAST(epoch_ms(ntime * 1000) AS DATE) AS VARCHAR) AS date FROM chain WHERE block_hash NOT IN (SELECT block_hash FROM canonical) AND ntime <> 0 AND ntime < (SELECT ntime FROM tip) - 7200)
SELECT date, count(*) AS orphan_blocks FROM (SELECT * FROM early UNION ALL SELECT * FROM dated WHERE block_hash NOT IN (SELECT block_hash FROM early)) GROUP BY date""")
def daily_orphans_of_both_arms(L):
    """Stale headers by their own date if two hours old, and captured orphans by the canonical block's date if 100 deep."""
    return D.orphans_of_both_arms(L.chain, tail_of(L).table("orphans"), L.block, utc_date)


# --- H4, H5: forks from links


@Ledger.view
def worked(L: Ledger) -> DataFrame:
    return H.cumulative_work(L.chain)


@query("SELECT x.block_hash AS tip_hash, x.true_height AS tip_height, x.prev_hash AS fork_hash, x.true_height - 1 AS fork_height, CAST(1 AS BIGINT) AS depth FROM chain x WHERE x.stale = 1 AND x.block_hash NOT IN (SELECT prev_hash FROM chain WHERE prev_hash IS NOT NULL)")
def side_tip_forks(L):
    return H.fork_points(L.chain, H.canonical_chain(written(worked(L), False)))


# The branch of a side tip: its own blocks, then the canonical chain below; local tips around the height of its fork.
_BRANCHES = """, branch AS (
  SELECT block_hash AS tip, block_hash, prev_hash, true_height AS height FROM chain WHERE stale = 1 AND block_hash NOT IN (SELECT prev_hash FROM chain WHERE prev_hash IS NOT NULL)
  UNION ALL SELECT b.tip, c.block_hash, c.prev_hash, c.true_height FROM branch b JOIN chain c ON c.block_hash = b.prev_hash WHERE b.block_hash NOT IN (SELECT block_hash FROM canonical)),
ends AS (SELECT tip, max(height) AS height, min(height) AS fork FROM branch GROUP BY tip),
locals AS (SELECT e.tip, e.height AS remote, e.fork, c.height AS local FROM ends e JOIN canonical c ON c.height BETWEEN e.fork AND e.height + 2)"""


@query(f"""{_BRANCHES} SELECT tip AS remote_tip, local AS local_height,
  CASE WHEN remote < local THEN remote WHEN (SELECT count(*) FROM canonical c JOIN branch b ON b.block_hash = c.block_hash WHERE b.tip = l.tip AND c.height = l.local) = 0 THEN local - 1 END AS back_to FROM locals l""")
def reorg_checks(L):
    """A node on the canonical chain meets each side branch, from its fork to two blocks past its tip: to which height it goes back."""
    main = written(H.canonical_chain(written(worked(L), False)), False)
    forks = written(H.fork_points(L.chain, main), False)
    met = forks.withColumn("local_height", F.explode(F.sequence("fork_height", F.col("tip_height") + 2))).join(main.select(F.col("height").alias("local_height")), "local_height", "left_semi")
    same = F.col("local_height") <= F.col("fork_height")
    return met.select(F.col("tip_hash").alias("remote_tip"), "local_height", H.reorg_height(F.col("local_height"), F.col("tip_height"), same).alias("back_to"))


# --- J6, J7: the mempool by snapshots and the feed of all changes


def mempool_of(L: Ledger) -> monitor.Mempool:
    """The mempool after all hourly snapshots, brought in four batches, the second twice."""
    made = monitor.Mempool(L.spark, f"{shared_dir(L.spark)}/mempool/{uuid.uuid4().hex}")
    rows = written(seen(L).select(F.col("user_id").alias("txid"), F.col("hour").alias("at")), False)
    lo, hi = rows.agg(F.min("at"), F.max("at")).first()
    edge = [lo + (hi - lo) * k // 4 for k in range(4)] + [hi]
    for a, b in ((lo - 1, edge[1]), (edge[1], edge[2]), (edge[1], edge[2]), (edge[2], edge[3]), (edge[3], hi)):
        made.apply(rows.where((F.col("at") > a) & (F.col("at") <= b)))
    return made


_STAYS = f""", seen AS ({_SEEN}), polls AS (SELECT hour, row_number() OVER (ORDER BY hour) AS k FROM (SELECT DISTINCT hour FROM seen)),
runs AS (SELECT user_id, k, hour, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS run FROM seen JOIN polls USING (hour)),
stays AS (SELECT user_id, min(hour) AS first_seen, max(k) AS hi FROM runs GROUP BY user_id, run),
changes AS (SELECT first_seen AS "at", user_id AS txid, 'added' AS kind, first_seen FROM stays UNION ALL SELECT p.hour, user_id, 'removed', first_seen FROM stays JOIN polls p ON p.k = hi + 1)"""


@query(f'{_STAYS} SELECT "at", txid, kind, first_seen FROM changes')
def mempool_changes(L):
    """What each snapshot added and removed, with the time since which an entry was there."""
    return mempool_of(L).table("changes")


@query(f"{_STAYS} SELECT user_id AS txid, first_seen FROM stays WHERE hi = (SELECT max(k) FROM polls)")
def mempool_entries(L):
    return mempool_of(L).table("entries")


@query(f"""{_STAYS} SELECT 'block' AS kind, CAST(height AS VARCHAR) AS id, ntime AS "at" FROM block UNION ALL SELECT 'tx', CAST(txid AS VARCHAR), ntime FROM tx JOIN block USING (height)
  UNION ALL SELECT 'reorg', block_hash, ntime FROM chain WHERE stale = 1 UNION ALL SELECT concat('mempool_', kind), CAST(txid AS VARCHAR), "at" FROM changes""")
def feed_of_all_changes(L):
    txs = L.tx.select("txid", "height").join(L.block.select("height", "ntime"), "height")
    return monitor.feed_events(L.block, txs, L.chain.where("stale = 1"), mempool_of(L).table("changes"))


# --- J16: alerts with states

_SPIKE, _SPIKE_TYPES = 2, ("error", "signup")  # more than so many of these in five minutes
_T = "SELECT DISTINCT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE ts IS NOT NULL"
_STATES = f"""
, slow AS (SELECT concat('slow ', event_type) AS rule, start AS "at" FROM ({_P95}) WHERE p95 > 100),
spike AS (SELECT 'errors' AS rule, w AS "at" FROM (SELECT unnest([CAST(floor(epoch(ts)) AS BIGINT) // 30 * 30 - 30 * k FOR k IN range(0, 10)]) AS w FROM events WHERE event_type IN {_SPIKE_TYPES}) GROUP BY w HAVING count(*) > {_SPIKE}),
silent AS (SELECT concat('silent ', event_type) AS rule, unnest(range(lo, hi + 30, 30)) AS "at" FROM (
  SELECT event_type, (since // 30 + 1) * 30 AS lo, (until - 300) // 30 * 30 AS hi FROM (SELECT event_type, t AS since, lead(t) OVER (PARTITION BY event_type ORDER BY t) AS until FROM ({_T})) WHERE until - since >= 300) WHERE lo <= hi),
holds AS (SELECT *, 180 AS secs FROM slow UNION ALL SELECT *, 60 FROM spike UNION ALL SELECT *, 300 FROM silent),
stay AS (SELECT rule, secs, min("at") AS a, max("at") AS z FROM (SELECT *, "at" - 30 * row_number() OVER (PARTITION BY rule ORDER BY "at") AS run FROM holds) GROUP BY rule, secs, run),
ends AS (SELECT max(t) // 30 * 30 AS last FROM ({_T}))
SELECT rule, a AS "at", 'pending' AS state FROM stay UNION ALL SELECT rule, a + secs, 'firing' FROM stay WHERE z - a >= secs
UNION ALL SELECT rule, z + 30, CASE WHEN z - a >= secs THEN 'resolved' ELSE 'inactive' END FROM stay, ends WHERE z + 30 <= last"""


@query(_STATES)
def alert_states(L):
    """Three rules over five-minute windows: a high 95th percentile, a sum of errors, and silence; with all their states."""
    events = L.table("events")
    last = events.agg((F.floor(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) / 30) * 30).cast("long").alias("last"))
    named = lambda df, word, at: df.select(F.concat(F.lit(f"{word} "), F.col("event_type")).alias("rule"), F.col(at).alias("at"))
    slow = named(live.bucket_quantiles(events, 0.95).where("p95 > 100"), "slow", "start")
    some = live.alert_windows(events.where(F.col("event_type").isin(*_SPIKE_TYPES))).groupBy(F.col("start").alias("at")).agg(F.sum("n").alias("n"))
    spike = some.where(F.col("n") > _SPIKE).select(F.lit("errors").alias("rule"), "at")
    silent = named(monitor.silences(events), "silent", "at")
    parts = [monitor.transitions(h, s, last) for h, s in ((slow, 180), (spike, 60), (silent, 300))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- J12: wealth kept from balance changes


def wealth_of(L: Ledger) -> wealth_state.WealthState:
    """The wealth state after the ledger's credits and debits in four batches, in ranges of a few hundred holders."""
    made = wealth_state.WealthState(L.spark, f"{shared_dir(L.spark)}/wealth/{uuid.uuid4().hex}", bound=500)
    flows = credit(L).select("address", "height", F.col("value").alias("delta")).unionByName(debit(L).select("address", "height", (-F.col("value")).alias("delta")))
    flows = written(flows, False)
    top = tip(L).first().tip
    for k in range(4):
        lo, hi = (top + 1) * k // 4, (top + 1) * (k + 1) // 4 - 1
        made.apply(flows.where(F.col("height").between(lo, hi)).select("address", "delta"), lo, hi)
    return made


@query("SELECT rank, address, balance FROM rich")
def live_rich_list(L):
    return wealth_of(L).rich_list().select("rank", "address", "balance")


@query(f"""SELECT CAST(holders AS BIGINT) AS holders, CAST(total AS BIGINT) AS total, gini, nakamoto
  FROM (SELECT count(*) AS holders, sum(balance) AS total FROM holders), ({PLAIN_SQL["gini"]}), ({PLAIN_SQL["nakamoto"]})""")
def live_wealth(L):
    made = wealth_of(L)
    holders, total = made.totals()
    return exact(L.spark.createDataFrame([(holders, Decimal(total), made.gini(), made.nakamoto())], "holders long, total decimal(38,0), gini double, nakamoto long"), "total")
