"""Registered ledger queries of value flow, recovered inputs, address pages of each detail level and lookups by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import address as A
from ..operators import daily as D
from ..operators import flow
from ..operators import joins as J
from ..sources import lookup
from .catalog import joined, ptx, query, totals
from .scratch import shared_dir, written

_INPUTS = "SELECT j.*, CAST(row_number() OVER (PARTITION BY txid ORDER BY prev_txid, prev_vout) - 1 AS INT) AS i FROM joined j"
#: The output that a coinstake staked: the first with two addresses, else the first with any.
_STAKED = """SELECT o.txid, o.addr_a, o.addr_b FROM outs o JOIN (
  SELECT txid, coalesce(min(vout) FILTER (kind = 2), min(vout)) AS vout FROM outs JOIN tx USING (txid) WHERE ty = 1 AND value > 0 AND addr_a IS NOT NULL GROUP BY txid) p USING (txid, vout)"""
_RECOVERED = f"""SELECT i.txid, i.i, s.addr_a, s.addr_b, CASE WHEN p.with_prevout = 1 AND p.out_sum >= p.era_reward THEN p.out_sum - p.era_reward END AS value
  FROM ({_INPUTS}) i JOIN ptx p USING (txid) JOIN ({_STAKED}) s USING (txid) WHERE p.ty = 1 AND i.value IS NULL"""


@query(f"SELECT txid, i, concat_ws(',', addr_a, addr_b) AS addresses, value FROM ({_RECOVERED})")
def recovered_inputs(L):
    """Inputs of coinstakes that nothing resolves: the staked output's addresses, and the value where there is one input."""
    rows = flow.recovered(flow.numbered(joined(L)), L.out, ptx(L))
    return rows.select("txid", "i", F.concat_ws(",", "addr_a", "addr_b").alias("addresses"), "value")


@query(f"""SELECT txid, src, dst, CAST(sum(value) AS BIGINT) AS value FROM (
  SELECT i.txid, CASE WHEN coalesce(i.addr_b, i.addr_a, r.addr_b, r.addr_a) IS NULL THEN concat('coinbase#', CAST(i.i AS VARCHAR)) ELSE concat('in:', coalesce(i.addr_b, i.addr_a, r.addr_b, r.addr_a)) END AS src,
         'TX' AS dst, coalesce(i.value, r.value, 0) AS value FROM ({_INPUTS}) i LEFT JOIN ({_RECOVERED}) r ON r.txid = i.txid AND r.i = i.i
  UNION ALL SELECT txid, 'TX', CASE WHEN addr_a IS NULL THEN concat('out#', CAST(vout AS VARCHAR)) ELSE concat('out:', coalesce(addr_b, addr_a)) END, value FROM outs
  UNION ALL SELECT txid, CASE WHEN value_balance < 0 THEN 'TX' ELSE 'POOL' END, CASE WHEN value_balance < 0 THEN 'POOL' ELSE 'TX' END, abs(value_balance) FROM tx)
  WHERE value > 0 GROUP BY txid, src, dst""")
def value_flow(L):
    """Edges from each party into a transaction, out of it, and across the shielded pool's boundary; a cold stake's party is its owner."""
    return flow.edges(joined(L), L.out, L.tx, ptx(L))


_LEVELS = """, mine AS (SELECT a.*, row_number() OVER (PARTITION BY address ORDER BY a.height DESC, a.txid) AS pos, p.fee FROM address_tx a JOIN ptx p USING (txid) WHERE address IN (SELECT address FROM rich)),
sized AS (SELECT address, count(*) AS txs FROM mine GROUP BY address),
page AS (SELECT address, count(*) AS items, string_agg(CAST(txid AS VARCHAR), ',' ORDER BY pos) AS txids, string_agg(concat_ws(':', CAST(txid AS VARCHAR), CAST(height AS VARCHAR), CAST(fee AS VARCHAR)), ',' ORDER BY pos) AS transactions
  FROM mine WHERE pos BETWEEN 11 AND 20 GROUP BY address)
SELECT t.address, level, CAST(2 AS INT) AS page, CAST((s.txs + 9) // 10 AS BIGINT) AS total_pages, CAST(coalesce(p.items, 0) AS BIGINT) AS items, s.txs, t.balance, t.received, t.sent,
  CASE WHEN level = 'txids' THEN coalesce(p.txids, '') END AS txids, CASE WHEN level = 'txs' THEN coalesce(p.transactions, '') END AS transactions
FROM totals t JOIN sized s USING (address) LEFT JOIN page p USING (address), (SELECT unnest(['basic', 'txids', 'txs']) AS level)"""


@query(_LEVELS)
def address_page_levels(L):
    """The second page of ten of each of the largest holders, in each level of detail, past-the-end pages too."""
    asked = written(totals(L).where("balance > 0").orderBy(F.desc("balance"), "address").limit(1000), False)
    rows = written(A.touching(asked, L.made, L.spends), False)
    shown = F.broadcast(J.newest_first(rows, "address", [F.desc("height"), "txid"], 2, 10).select("txid").distinct())  # ten for each address
    ins = written(L.spends.join(shown, "txid", "left_semi"), False)
    spent = L.made.where("height >= 0").join(F.broadcast(ins.select(F.col("prev_txid").alias("txid")).distinct()), "txid", "left_semi")
    mine = lambda df: df.join(shown, "txid", "left_semi")
    details = D.per_transaction(mine(L.tx), mine(L.out), J.resolve(ins, spent), 1500)
    made = [A.page(rows, asked, details, 2, 10, level).withColumn("level", F.lit(level)) for level in ("basic", "txids", "txs")]
    flat = lambda df: df.withColumn("txids", F.array_join(F.col("txids").cast("array<string>"), ",")).withColumn("transactions", F.array_join("transactions", ","))
    return flat(made[0].unionByName(made[1]).unionByName(made[2]))


@query("SELECT q.prev_hash AS block_hash, p.true_height AS height, p.ntime, p.stale FROM (SELECT DISTINCT prev_hash FROM chain WHERE prev_hash IS NOT NULL) q JOIN chain p ON p.block_hash = q.prev_hash")
def block_by_hash(L):
    """Blocks by hash, each one's parent being asked for, in a table that is sorted for such lookups."""
    path = f"{shared_dir(L.spark)}/lookup/{uuid.uuid4().hex}"
    lookup.write_sorted(L.chain.select("block_hash", F.col("true_height").alias("height"), "ntime", "stale"), path, "block_hash")
    return lookup.rows_of(L.spark, path, L.chain.select(F.col("prev_hash").alias("block_hash")), "block_hash")
