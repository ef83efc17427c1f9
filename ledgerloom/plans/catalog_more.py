"""More registered ledger queries: reports, recovery, pages, governance and the live lane."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import address as A
from ..operators import daily as D
from ..operators import governance as G
from ..operators import joins as J
from ..operators import reports as R
from ..operators import wealth as V
from ..sources.ledger import COIN, wide
from ..streaming import live
from .catalog import _TALLY, _VOTED, OPERATORS, PLAIN_SQL, allocation_sql, credit, daily, days, debit, denominator, joined, ptx, query, tip, totals, utxo  # noqa: F401
from .scratch import exact


@query("SELECT txid, height, CASE WHEN height = 0 THEN 'genesis' ELSE 'canonical' END AS status, height > 100 AS is_pos FROM tx")
def height_statuses(L):
    return L.tx.select("txid", "height", S.height_status(F.col("height")).alias("status"), (F.col("height") > 100).alias("is_pos"))


@query("SELECT txid, CAST(count(*) FILTER (value_balance <> 0) AS BIGINT) AS shielded, CAST(sum(value_balance) AS DOUBLE) / 100000000.0::DOUBLE AS coins FROM tx GROUP BY txid")
def shield_summary(L):
    return L.tx.groupBy("txid").agg(F.count(F.when(F.col("value_balance") != 0, 1)).alias("shielded"), (F.sum("value_balance").cast("double") / F.lit(float(COIN))).alias("coins"))


@query("SELECT txid, coalesce(arg_min(vout, vout) FILTER (kind = 2), min(vout)) AS staked_vout FROM tx JOIN outs USING (txid) WHERE ty = 1 AND value > 0 AND addr_a IS NOT NULL GROUP BY txid")
def staked_output_pick(L):
    rows = L.tx.where("ty = 1").select("txid").join(L.out.where("value > 0 AND addr_a IS NOT NULL"), "txid")
    return rows.groupBy("txid").agg(F.coalesce(F.min(F.when(F.col("kind") == 2, F.col("vout"))), F.min("vout")).alias("staked_vout"))


@query("SELECT p.txid, CASE WHEN with_prevout = 1 AND out_sum >= era_reward THEN out_sum - era_reward END AS recovered FROM ptx p WHERE ty = 1 AND resolved < with_prevout")
def coinstake_recovery(L):
    v = F.col("out_sum") - F.col("era_reward")
    return ptx(L).where("ty = 1 AND resolved < with_prevout").select("txid", F.when((F.col("with_prevout") == 1) & (v >= 0), v).alias("recovered"))


@query("SELECT account, chain, idx, a.address FROM account_address a JOIN (SELECT DISTINCT address FROM address_tx) t USING (address)")
def account_tokens_used(L):
    used = A.address_txs(credit(L), debit(L)).select("address").distinct()
    return L.account_address.join(used, "address", "left_semi").select("account", "chain", "idx", "address")


@query("SELECT account, address, CAST(pos AS INT) AS pos, CAST((n + 9) // 10 AS BIGINT) AS pages FROM (SELECT account, address, row_number() OVER (PARTITION BY account ORDER BY chain, idx) AS pos, count(*) OVER (PARTITION BY account) AS n FROM account_address) WHERE pos BETWEEN 1 AND 10")
def token_pages(L):
    n = L.account_address.groupBy("account").agg(F.count("*").alias("n"))
    rows = J.newest_first(L.account_address, "account", ["chain", "idx"], 1, 10).join(n, "account")
    return rows.select("account", "address", "pos", S.div(F.col("n") + 9, 10).alias("pages"))


@query("SELECT (SELECT count(*) FROM tx) AS txs, (SELECT count(*) FROM tx WHERE height >= 0) AS valid, (SELECT count(*) FROM joined WHERE value IS NULL) AS unresolved, (SELECT count(*) FROM address_tx) AS address_rows")
def coverage_validation(L):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(L.tx, "txs").crossJoin(n(L.tx.where("height >= 0"), "valid")).crossJoin(n(joined(L).where("value IS NULL"), "unresolved")).crossJoin(n(A.address_txs(credit(L), debit(L)), "address_rows"))


@query("SELECT c.address, c.received, CAST(c.received - coalesce(u.v, 0) AS BIGINT) AS sent FROM (SELECT address, CAST(sum(value) AS BIGINT) AS received FROM credit GROUP BY address) c LEFT JOIN (SELECT address, sum(value) AS v FROM utxo GROUP BY address) u USING (address)")
def totals_from_unspent(L):
    r = credit(L).groupBy("address").agg(wide("value").alias("r"))
    u = utxo(L).groupBy("address").agg(wide("value").alias("v"))
    return r.join(u, "address", "left").select("address", F.col("r").cast("long").alias("received"), (F.col("r") - F.coalesce("v", F.lit(0))).cast("long").alias("sent"))


@query("SELECT CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS bytes, (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events) - min(CAST(floor(epoch(ts)) AS BIGINT)) AS oldest_age FROM events GROUP BY 1")
def mempool_totals(L):
    e = L.table("events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "user_id")
    now = e.agg(F.max("t").alias("now"))
    g = e.groupBy(S.div(F.col("t"), 86_400).alias("day")).agg(F.count("*").alias("n"), F.sum(F.coalesce("user_id", F.lit(0)).cast("long")).alias("bytes"), F.min("t").alias("first"))
    return g.crossJoin(F.broadcast(now)).select("day", "n", "bytes", (F.col("now") - F.col("first")).alias("oldest_age"))


@query("SELECT CAST(sum(CASE WHEN ty = 0 THEN value ELSE 0 END) AS BIGINT) AS transparent, CAST(sum(CASE WHEN ty <> 0 THEN value ELSE 0 END) AS BIGINT) AS staked, round(CAST(sum(CASE WHEN ty <> 0 THEN value ELSE 0 END) AS DOUBLE) * 100.0 / CAST(sum(value) AS DOUBLE), 6) AS staked_pct FROM (SELECT DISTINCT txid, vout, value, ty FROM utxo)")
def supply_snapshot(L):
    u = utxo(L).select("txid", "vout", "value", "ty").distinct()
    s = u.agg(wide(F.when(F.col("ty") == 0, F.col("value")).otherwise(0)).alias("a"), wide(F.when(F.col("ty") != 0, F.col("value")).otherwise(0)).alias("b"), wide("value").alias("t"))
    return exact(s.select(F.col("a").alias("transparent"), F.col("b").alias("staked"), F.when(F.col("t") > 0, F.round(F.col("b").cast("double") * 100.0 / F.col("t").cast("double"), 6)).otherwise(0.0).alias("staked_pct")), "transparent", "staked")


@query("SELECT o.txid, o.vout FROM outs o WHERE EXISTS (SELECT 1 FROM inp i WHERE i.prev_txid = o.txid AND i.prev_vout = o.vout) AND NOT EXISTS (SELECT 1 FROM inp i JOIN tx USING (txid) WHERE i.prev_txid = o.txid AND i.prev_vout = o.vout AND tx.height < 100)")
def late_spends(L):
    spend = L.inp.join(L.tx.select("txid", "height"), "txid").select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"), "height")
    return L.out.select("txid", "vout").join(spend.groupBy("txid", "vout").agg(F.min("height").alias("first")).where("first >= 100"), ["txid", "vout"], "left_semi")


@query("SELECT height, date, treasury AS total_paid, era FROM (SELECT height, date, treasury, CASE WHEN ty = 2 THEN 'work' ELSE 'stake' END AS era FROM ptx JOIN block USING (height) WHERE treasury > 0)")
def treasury_history(L):
    rows = ptx(L).join(L.block.select("height", "date"), "height")
    era = lambda c, name: rows.where(c).where("treasury > 0").select("height", "date", F.col("treasury").alias("total_paid"), F.lit(name).alias("era"))
    return era("ty = 2", "work").unionByName(era("ty = 1", "stake"))


@query("SELECT date, cumulative FROM (SELECT date, blocks, CAST(sum(p2cs_created - p2cs_spent) OVER (ORDER BY date) AS BIGINT) AS cumulative FROM daily) WHERE date <> (SELECT date FROM tip) ORDER BY date DESC LIMIT 30")
def cold_staking_report(L):
    """The curve over all days first, then trimmed, then the last 30."""
    return exact(D.complete_days(R.delegation_curve(daily(L)), tip(L).select("date"), 30, 1, slice_first=False).select("date", "cumulative"), "cumulative")


@query(f"""SELECT s.n, CAST(d.denominator AS DOUBLE) AS total, round(CAST(t.v AS DOUBLE) * 100.0 / CAST(d.denominator AS DOUBLE), 6) AS share
  FROM (SELECT count(*) AS n FROM holders) s, ({PLAIN_SQL["supply_denominator"]}) d, (SELECT sum(balance) AS v FROM rich WHERE rank <= 100) t""")
def wealth_report(L):
    """Holders, the supply (each coin once) and the share of the hundred largest in it."""
    s = V.top_shares(totals(L)).crossJoin(denominator(L))  # one row each
    total = F.col("denominator").cast("double")
    return s.select(F.col("holders").alias("n"), total.alias("total"), F.round(F.col("top100").cast("double") * 100.0 / total, 6).alias("share"))


@query("SELECT lo_coins, n, round(n * 100.0 / (SELECT count(*) FROM holders), 6) AS pct FROM (SELECT CASE WHEN balance >= 10000000000000 THEN 100000 WHEN balance >= 1000000000000 THEN 10000 WHEN balance >= 100000000000 THEN 1000 WHEN balance >= 10000000000 THEN 100 WHEN balance >= 1000000000 THEN 10 WHEN balance >= 100000000 THEN 1 ELSE 0 END::BIGINT AS lo_coins, count(*) AS n FROM holders GROUP BY 1)")
def holder_shares(L):
    h = V.histogram(totals(L)).where("n > 0")
    return h.crossJoin(F.broadcast(h.agg(F.sum("n").alias("t")))).select("lo_coins", "n", F.round(F.col("n") * 100.0 / F.col("t"), 6).alias("pct"))


@query("SELECT hour, n FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS hour, count(*) AS n FROM events GROUP BY 1) WHERE hour >= (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events) - 24 * 3600")
def network_snapshots(L):
    h = live.hourly(L.table("events")).select("hour", "n")
    now = L.table("events").agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("now"))
    return h.crossJoin(F.broadcast(now)).where("hour >= now - 24 * 3600").select("hour", "n")


@query("SELECT hour FROM (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS hour FROM events) ORDER BY hour DESC LIMIT 8760")
def snapshot_retention(L):
    return live.hourly(L.table("events")).select("hour").orderBy(F.desc("hour")).limit(8760)


@query("SELECT max(date) AS date, arg_max(tx_count, date) AS tx_count, arg_max(active_addresses, date) AS active_addresses, round(arg_max(CAST(fees_total AS DOUBLE), date) / 100000000.0 * 0.25, 6) AS fees_usd FROM days")
def headline_tiles(L):
    return days(L).agg(F.max("date").alias("date"), F.max_by("tx_count", "date").alias("tx_count"), F.max_by("active_addresses", "date").alias("active_addresses"), F.round(F.max_by(F.col("fees_total").cast("double"), "date") / 100000000.0 * 0.25, 6).alias("fees_usd"))


# --- J: live


@query("SELECT block_hash, CASE WHEN true_height % 50 = 7 THEN 'pending' WHEN stale = 0 THEN 'canonical' ELSE 'orphan' END AS state FROM chain")
def orphan_tail_states(L):
    known = L.block.where("height % 50 <> 7").select(F.col("height").alias("true_height"), F.concat(F.lit("B"), F.col("height").cast("string")).alias("ch"))
    return L.chain.join(known, "true_height", "left").select("block_hash", live.tail_state(F.col("block_hash"), F.col("ch")).alias("state"))


@query("""SELECT w AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(count(*) / 300.0, 6) AS rate FROM (
  SELECT event_type, value, unnest([CAST(floor(epoch(ts)) AS BIGINT) // 30 * 30 - 30 * k FOR k IN range(0, 10)]) AS w FROM events) GROUP BY w, event_type""")
def metric_alert_windows(L):
    return live.alert_windows(L.table("events"))


@query("SELECT height, height % 7 <> 0 AND height % 11 <> 0 AND (height < 60 OR height % 60 >= 30) AS due FROM block")
def recompute_gate(L):
    h = F.col("height")
    last = F.when(h < 60, -1).otherwise(h - h % 60)
    return L.block.select("height", live.recompute_due(h % 7 != 0, h % 11 == 0, h, last, F.lit(30)).alias("due"))


@query("""SELECT 'block' AS kind, CAST(height AS VARCHAR) AS id FROM block UNION ALL SELECT 'tx', CAST(txid AS VARCHAR) FROM tx UNION ALL SELECT 'reorg', block_hash FROM chain WHERE stale = 1""")
def change_feed(L):
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    return row(L.block, "block", "height").unionByName(row(L.tx, "tx", "txid")).unionByName(row(L.chain.where("stale = 1"), "reorg", "block_hash"))


@query("""SELECT u.address, u.txid, u.vout, u.value FROM utxo u WHERE u.height <= (SELECT tip FROM tip) - 200
  UNION ALL SELECT c.address, c.txid, c.vout, c.value FROM credit c WHERE c.value > 0 AND c.height <= (SELECT tip FROM tip) - 200 AND EXISTS (SELECT 1 FROM inp i JOIN tx t USING (txid) WHERE i.prev_txid = c.txid AND i.prev_vout = c.vout)
    AND NOT EXISTS (SELECT 1 FROM inp i JOIN tx t USING (txid) WHERE i.prev_txid = c.txid AND i.prev_vout = c.vout AND t.height <= (SELECT tip FROM tip) - 200)""")
def rollback_utxos(L):
    """The unspent outputs as they stood at the fork: created there or before, and not spent by then."""
    fork = F.broadcast(tip(L).select((F.col("tip") - 200).alias("fork")))
    early = L.inp.join(L.tx.select("txid", "height"), "txid").crossJoin(fork).where("height <= fork").select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"))
    made = credit(L).where("value > 0").crossJoin(fork).where("height <= fork")
    return made.join(early, ["txid", "vout"], "left_anti").select("address", "txid", "vout", "value")


# --- K: governance


_SPANNING = f"""SELECT cycle, proposal_id, yeas - nays AS net, monthly_payment AS amount, yeas - nays > 100 AS eligible FROM proposal
  WHERE block_start <= (cycle + 1) * {S.BUDGET_CYCLE} AND (cycle + 1) * {S.BUDGET_CYCLE} <= block_end AND monthly_payment > 0"""


@query(f"{allocation_sql(_SPANNING)} SELECT cycle, proposal_id, outcome, spent_before FROM fold WHERE r > 0")
def funded_this_cycle(L):
    """Proposals whose span holds the superblock of their cycle, allocated under the cap.

    The cap's half unit of tolerance admits nothing more here: payments are whole.
    """
    net = F.col("yeas") - F.col("nays")
    sb = (F.col("cycle") + 1) * S.BUDGET_CYCLE
    live_ones = L.proposal.where((F.col("block_start") <= sb) & (sb <= F.col("block_end")) & (F.col("monthly_payment") > 0))
    return G.allocate(live_ones.select("cycle", "proposal_id", net.alias("net"), F.col("monthly_payment").alias("amount"), (net > 100).alias("eligible")), G.CAP)


@query(f"""{allocation_sql(_SPANNING)} SELECT proposal_id, CASE WHEN monthly_payment <= 0 THEN 'invalid' WHEN block_end <= 259200 THEN 'completed' WHEN yeas - nays <= 100 THEN 'failing'
  WHEN proposal_id IN (SELECT proposal_id FROM fold WHERE outcome = 'funded') THEN 'passing' ELSE 'passing-unfunded' END AS status FROM proposal""")
def proposal_status(L):
    """A passing proposal is funded if the allocation of its cycle's superblock pays it."""
    paid = funded_this_cycle(L).where("outcome = 'funded'").select("proposal_id", F.lit(True).alias("paid"))
    p = L.proposal.join(paid, "proposal_id", "left")
    return p.select("proposal_id", G.status(F.lit(259_200), F.col("block_end"), F.col("yeas") - F.col("nays") > 100, F.coalesce("paid", F.lit(False)), F.col("monthly_payment") > 0).alias("status"))


@query(f"""{allocation_sql(_VOTED)}, mine AS (SELECT cycle, proposal_id FROM proposal WHERE yeas > 400), paid AS (SELECT cycle, proposal_id FROM fold WHERE outcome = 'funded')
  SELECT cycle, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM (
    SELECT cycle, 1 AS added, 0 AS removed FROM mine ANTI JOIN paid USING (cycle, proposal_id) UNION ALL SELECT cycle, 0, 1 FROM paid ANTI JOIN mine USING (cycle, proposal_id)) GROUP BY cycle""")
def selection_delta(L):
    """Of each cycle: how many of the selected proposals the allocation doesn't fund, and of the funded ones aren't selected."""
    net = F.col("yeas") - F.col("nays")
    voted = L.proposal.select("cycle", "proposal_id", net.alias("net"), F.col("monthly_payment").alias("amount"), (net > 100).alias("eligible"))
    return G.selection_delta(L.proposal.where("yeas > 400"), G.allocate(voted).where("outcome = 'funded'"))
