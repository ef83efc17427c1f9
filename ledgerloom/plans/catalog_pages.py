"""Registered ledger queries of explorer pages, searches, and alerts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import daily as D
from ..operators import joins as J
from ..operators import pages as P
from ..operators import wealth as V
from ..sources.ledger import wide
from ..streaming import live
from . import catalog as C
from .catalog import PLAIN_SQL, credit, ptx, query, tip, totals, utxo
from .scratch import exact

# --- attribution and coin sets

#: The decoded addresses of an output: markers, two owners, one, or none.
_DECODED = f"""SELECT o.*, t.height, t.ty, s.script, CASE WHEN t.ty = 1 AND vout = 0 THEN ['CoinStakeTx'] WHEN kind = 2 THEN [addr_a, addr_b] WHEN addr_a IS NOT NULL THEN [addr_a]
  WHEN o.txid % 5 = 0 THEN ['Nonstandard'] WHEN o.txid % 5 = 1 THEN ['D1', 'D2'] WHEN o.txid % 5 = 2 THEN [concat('D', CAST(cust AS VARCHAR))] ELSE [] END AS addresses
  FROM outs o JOIN tx t USING (txid) JOIN ({C._SCRIPTS}) s USING (txid, vout)"""


def decoded(L):
    k, some = F.col("txid") % 5, lambda *x: F.array(*x)
    addresses = (
        F.when((F.col("ty") == 1) & (F.col("vout") == 0), some(F.lit("CoinStakeTx"))).when(F.col("kind") == 2, some("addr_a", "addr_b")).when(F.col("addr_a").isNotNull(), some("addr_a"))
        .when(k == 0, some(F.lit("Nonstandard"))).when(k == 1, some(F.lit("D1"), F.lit("D2"))).when(k == 2, some(F.concat(F.lit("D"), F.col("cust").cast("string")))).otherwise(F.array().cast("array<string>"))
    )
    return L.out.join(L.tx.select("txid", "height", "ty", "cust"), "txid").withColumns({"script": C.script_of(), "addresses": addresses})


@query(f"""SELECT txid, vout, k AS kind, CASE WHEN k >= 1 THEN addresses[1] END AS addr_a, CASE WHEN k = 2 THEN addresses[2] END AS addr_b FROM (
  SELECT *, CASE WHEN len(addresses) = 0 OR list_has_any(addresses, ['CoinBaseTx', 'CoinStakeTx', 'Nonstandard']) OR (value = 0 AND (script = '' OR script LIKE '6A%')) THEN 0
    WHEN script LIKE '76A97B63D114%' AND len(addresses) = 2 THEN 2 WHEN len(addresses) = 1 THEN 1 ELSE 0 END AS k FROM ({_DECODED}))""")
def output_attribution(L):
    return decoded(L).select("txid", "vout", P.attribution(F.col("addresses"), F.col("value"), F.col("script")).alias("a")).select("txid", "vout", "a.*")


_MARKED = "a NOT IN ('CoinBaseTx', 'CoinStakeTx', 'Nonstandard')"
_COINS = f"""coins AS MATERIALIZED (SELECT d.*, d.ty = 2 AS cb, lower(substr(script, 1, 12)) AS p FROM ({_DECODED}) d JOIN unspent u USING (txid, vout) WHERE d.value <> 0),
named AS (SELECT cb, height, value, unnest(addresses) AS a FROM coins)"""


@query(f""", {_COINS}, entries AS (
  SELECT 'plain' AS options, a AS address, value AS v, CASE WHEN cb THEN value ELSE 0 END AS c FROM named WHERE {_MARKED}
  UNION ALL SELECT 'plain', concat('UNKNOWN_COINBASE_', p), 0, value FROM coins WHERE len(addresses) = 0 AND cb
  UNION ALL SELECT 'mature', a, CASE WHEN NOT cb OR height + 100 <= (SELECT tip FROM tip) THEN value ELSE 0 END, CASE WHEN cb THEN value ELSE 0 END FROM named WHERE {_MARKED}
  UNION ALL SELECT 'mature', concat('UNKNOWN_COINBASE_', p), 0, value FROM coins WHERE len(addresses) = 0 AND cb
  UNION ALL SELECT 'everything', a, CASE WHEN NOT cb THEN value ELSE 0 END, CASE WHEN cb THEN value ELSE 0 END FROM named WHERE {_MARKED}
  UNION ALL SELECT 'everything', concat('UNKNOWN_COINBASE_', p), 0, value FROM coins WHERE len(addresses) = 0 AND cb
  UNION ALL SELECT 'everything', concat('UNKNOWN_', p), value, 0 FROM coins WHERE len(addresses) = 0
  UNION ALL SELECT 'everything', 'SHIELDED_UNKNOWN', value, CASE WHEN cb THEN value ELSE 0 END FROM coins WHERE len(addresses) = 0)
  SELECT options, address, CAST(sum(v) AS BIGINT) AS balance, CAST(sum(c) AS BIGINT) AS coinbase_balance FROM entries WHERE v <> 0 OR c <> 0 GROUP BY options, address""")
def coin_set_options(L):
    """Balances of the coin set: plain, with mature coinbase only, and without coinbase but with unknown and shielded coins."""
    unspent = J.unspent(L.out, L.inp).select("txid", "vout")
    coins = decoded(L).join(unspent, ["txid", "vout"], "left_semi").select("addresses", "value", (F.col("ty") == 2).alias("is_coinbase"), "height", "script")
    sets = {"plain": {}, "mature": {"maturity": S.MATURITY, "tip": tip(L).first().tip}, "everything": {"coinbase": False, "unknown": True, "shielded": True}}
    named = [P.coin_set(coins, **options).select(F.lit(name).alias("options"), "*") for name, options in sets.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- pages


@query(f""", flag AS ({PLAIN_SQL["output_spent_flag"]}),
  vin AS (SELECT txid, string_agg(concat(prev_txid, ':', prev_vout, ':', coalesce(CAST(value AS VARCHAR), '?'), ':', concat_ws('|', addr_a, addr_b)), ',' ORDER BY prev_txid, prev_vout) AS vin FROM joined GROUP BY txid),
  vout AS (SELECT txid, string_agg(concat(vout, ':', value, ':', concat_ws('|', addr_a, addr_b), ':', coalesce(CAST(spent AS VARCHAR), '?')), ',' ORDER BY vout) AS vout FROM outs JOIN flag USING (txid, vout) GROUP BY txid)
  SELECT txid, height, CASE WHEN height <= 0 THEN 0 ELSE greatest((SELECT tip FROM tip) - height + 1, 0) END AS confirmations, greatest(in_sum + value_balance - out_sum, 0) AS fee, in_sum, out_sum,
    coalesce(vin, '') AS vin, coalesce(vout, '') AS vout FROM ptx LEFT JOIN vin USING (txid) LEFT JOIN vout USING (txid)""")
def transaction_page(L):
    """The page's nested arrays, written out as text."""
    flagged = J.spent_flags(L.made, L.spends, "value", "kind", "addr_a", "addr_b")
    pages = P.transaction_pages(D.per_transaction(L.tx, flagged, C.spent(L), 1500, (P.vout_list(),), (P.vin_list(),)), tip(L))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    line = lambda *x: F.concat_ws(":", *x)
    owners = lambda x: F.array_join(x["addresses"], "|")
    return pages.withColumns({
        "vin": F.array_join(F.transform("vin", lambda x: line(text(x["prev_txid"]), text(x["prev_vout"]), text(x["value"]), owners(x))), ","),
        "vout": F.array_join(F.transform("vout", lambda x: line(text(x["vout"]), text(x["value"]), owners(x), text(x["spent"]))), ","),
    })


@query(f"""SELECT height, concat('B', CAST(height AS VARCHAR)) AS block_hash, CASE WHEN height > 0 THEN concat('B', CAST(height - 1 AS VARCHAR)) END AS prev_hash, ntime, nbits, round({C._DIFFICULTY}, 6) AS difficulty,
  (SELECT tip FROM tip) - height + 1 AS confirmations, size, scheduled, d.n_tx, value_in, value_out, fees, reward, txids
  FROM block JOIN ({PLAIN_SQL["block_detail"]}) d USING (height) JOIN (SELECT height, CAST(sum(raw_len) AS BIGINT) AS size, max(era_reward) AS scheduled FROM ptx GROUP BY height) USING (height)""")
def block_page(L):
    """A block's header, its size and scheduled reward beside the detail of its transactions."""
    name = lambda h: F.concat(F.lit("B"), h.cast("string"))
    h = F.col("height")
    sums = ptx(L).groupBy("height").agg(F.sum("raw_len").alias("size"), F.max("era_reward").cast("long").alias("scheduled"))
    rows = L.block.select("height", "ntime", "nbits").join(C.OPERATORS["block_detail"](L), "height").join(sums, "height").crossJoin(F.broadcast(tip(L).select("tip")))
    return rows.select(
        "height", name(h).alias("block_hash"), F.when(h > 0, name(h - 1)).alias("prev_hash"), "ntime", "nbits", F.round(S.difficulty("nbits"), 6).alias("difficulty"),
        (F.col("tip") - h + 1).alias("confirmations"), "size", "scheduled", "n_tx", "value_in", "value_out", "fees", "reward", "txids",
    )


_SEARCHED = """SELECT CASE WHEN txid % 3 = 0 THEN concat('  ', CAST(txid AS VARCHAR), ' ') ELSE CAST(txid AS VARCHAR) END AS q FROM tx UNION ALL SELECT concat('T', CAST(txid + txid % 2 AS VARCHAR)) FROM tx
  UNION ALL SELECT block_hash FROM chain UNION ALL SELECT concat('D', CAST(c_custkey AS VARCHAR)) FROM customer UNION ALL SELECT concat('xpub', CAST(c_nationkey + c_custkey % 2 * 20 AS VARCHAR)) FROM customer
  UNION ALL SELECT repeat(' ', CAST(r_regionkey AS INT)) FROM region"""


@query(f"""SELECT q, coalesce(CASE WHEN b.height IS NOT NULL OR c.true_height IS NOT NULL THEN 'block' WHEN t.txid IS NOT NULL THEN 'tx' WHEN a.address IS NOT NULL THEN 'address' WHEN x.account IS NOT NULL THEN 'account' END, 'not-found') AS found,
  coalesce(b.height, c.true_height, t.height) AS height FROM (SELECT q, trim(q) AS k FROM ({_SEARCHED})) LEFT JOIN block b ON CAST(b.height AS VARCHAR) = k LEFT JOIN (SELECT DISTINCT block_hash, true_height FROM chain) c ON c.block_hash = k
  LEFT JOIN tx t ON concat('T', CAST(t.txid AS VARCHAR)) = k LEFT JOIN totals a ON a.address = k LEFT JOIN (SELECT DISTINCT account FROM account_address) x ON concat('xpub', CAST(x.account AS VARCHAR)) = k""")
def search_names(L):
    """Numbers, hashes, transactions, addresses and accounts, some of them unknown, looked up together."""
    k, words = F.col("txid"), lambda df, c: df.select(c.alias("q"))
    customer, number = L.table("customer"), k.cast("string")
    asked = words(L.tx, F.when(k % 3 == 0, F.concat(F.lit("  "), number, F.lit(" "))).otherwise(number)).unionByName(words(L.tx, F.concat(F.lit("T"), (k + k % 2).cast("string")))).unionByName(words(L.chain, F.col("block_hash")))
    asked = asked.unionByName(words(customer, F.concat(F.lit("D"), F.col("c_custkey").cast("string")))).unionByName(words(customer, F.concat(F.lit("xpub"), (F.col("c_nationkey") + F.col("c_custkey") % 2 * 20).cast("string"))))
    asked = asked.unionByName(words(L.table("region"), F.repeat(F.lit(" "), F.col("r_regionkey").cast("int"))))
    return P.search(asked, L.block, L.chain, L.tx, totals(L), L.account_address)


# --- figures

_AGES = (("under_1m", 0, 30), ("m1_3", 30, 90), ("m3_6", 90, 180), ("m6_12", 180, 365), ("y1_2", 365, 730), ("over_2y", 730, 1 << 40))


@query(f"""SELECT count(*) FILTER (status = 'ENABLED') AS enabled, count(*) FILTER (status = 'PRE_ENABLED') AS inqueue,
  round(CASE WHEN count(*) FILTER (status = 'ENABLED') > 0 THEN count(*) FILTER (status = 'PRE_ENABLED') * 100.0::DOUBLE / count(*) FILTER (status = 'ENABLED') ELSE 0 END, 6) AS queue_health,
  {", ".join(f"count(*) FILTER (activetime >= {lo} * 86400 AND activetime < {hi} * 86400) AS {n}" for n, lo, hi in _AGES)} FROM masternode""")
def masternode_health(L):
    n = lambda c: F.count(F.when(c, 1))
    a, on, waiting = F.col("activetime"), n(F.col("status") == "ENABLED"), n(F.col("status") == "PRE_ENABLED")
    ages = (n((a >= lo * 86400) & (a < hi * 86400)).alias(name) for name, lo, hi in _AGES)
    return L.masternode.agg(on.alias("enabled"), waiting.alias("inqueue"), F.round(F.when(on > 0, waiting * F.lit(100.0) / on).otherwise(0.0), 6).alias("queue_health"), *ages)


@query("""SELECT transparent + shielded AS total, transparent, shielded, CASE WHEN transparent + shielded = 0 THEN 0.0 ELSE round(CAST(shielded AS DOUBLE) * 100.0 / CAST(transparent + shielded AS DOUBLE), 6) END AS shielded_pct
  FROM (SELECT (SELECT CAST(coalesce(sum(value), 0) AS BIGINT) FROM unspent) AS transparent, (SELECT CAST(greatest(coalesce(-sum(value_balance), 0), 0) AS BIGINT) FROM tx) AS shielded)""")
def shield_supply(L):
    """Unspent outputs, and the shielded pool: what went in (a negative balance) less what came out, never below 0."""
    t = J.unspent(L.out, L.inp).agg(F.coalesce(wide("value"), F.lit(0)).cast("decimal(37,0)").alias("transparent"))
    s = L.tx.agg(F.greatest(F.coalesce(-wide("value_balance"), F.lit(0)), F.lit(0)).cast("decimal(37,0)").alias("shielded"))
    total = F.col("transparent") + F.col("shielded")
    pct = F.when(total == 0, 0.0).otherwise(F.round(F.col("shielded").cast("double") * 100.0 / total.cast("double"), 6))
    return exact(t.crossJoin(s).select(total.alias("total"), "transparent", "shielded", pct.alias("shielded_pct")), "total", "transparent", "shielded")  # one row each


@query(f"""SELECT arg_max(cycle, cycle) AS last_cycle, arg_max(total, cycle) AS last_total, round(CAST(sum(total) AS DOUBLE) / count(*), 6) AS mean_total FROM (
  SELECT * FROM ({PLAIN_SQL["treasury_cycles"]}) ORDER BY cycle DESC LIMIT 12)""")
def treasury_recent(L):
    """The last budget cycle with payouts and the mean of the last twelve."""
    last = C.OPERATORS["treasury_cycles"](L).orderBy(F.desc("cycle")).limit(12)
    return last.agg(F.max("cycle").alias("last_cycle"), F.max_by("total", "cycle").alias("last_total"), F.round(F.sum("total").cast("double") / F.count("*"), 6).alias("mean_total"))


_SHARES = ", ".join(f"round(CAST(w.{c} AS DOUBLE) * 100.0 / CAST(d.denominator AS DOUBLE), 6) AS {c}_pct" for c in ("top10", "top50", "top100", "top1000"))


@query(f"""SELECT w.holders, {_SHARES}, gini, nakamoto
  FROM ({PLAIN_SQL["wealth_sums"]}) w, ({PLAIN_SQL["supply_denominator"]}) d, ({PLAIN_SQL["gini"]}) g, ({PLAIN_SQL["nakamoto"]}) n""")
def wealth_overview(L):
    """Shares of the largest holders in the supply, in which a cold-staked coin counts once; Gini and Nakamoto; one row."""
    pct = lambda c: F.round(F.col(c).cast("double") * 100.0 / F.col("denominator").cast("double"), 6).alias(f"{c}_pct")
    s = V.top_shares(totals(L)).crossJoin(C.denominator(L)).select("holders", *(pct(c) for c in ("top10", "top50", "top100", "top1000")))
    return s.crossJoin(V.gini(totals(L)).select("gini")).crossJoin(V.nakamoto(totals(L)).select("nakamoto"))  # one row each


@query("""SELECT count(*) AS n, min(height) = 0 AND count(*) = max(height) + 1 AND count(*) = (SELECT count(DISTINCT block_hash) FROM chain WHERE stale = 0) AS complete FROM canonical""")
def contiguity_against_chain(L):
    expected = L.chain.where("stale = 0").select("block_hash").distinct().agg(F.count("*").alias("expected"))
    have = L.block.agg(F.count("*").alias("n"), F.min("height").alias("lo"), F.max("height").alias("hi"))
    return have.crossJoin(expected).select("n", ((F.col("lo") == 0) & (F.col("n") == F.col("hi") + 1) & (F.col("n") == F.col("expected"))).alias("complete"))


# --- mempool, watchdog and alerts

_SEEN = "SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS hour FROM events WHERE user_id IS NOT NULL"


def seen(L):
    hour = (S.div(F.unix_timestamp(F.col("ts").cast("timestamp")), 3600) * 3600).alias("hour")
    return L.table("events").where("user_id IS NOT NULL").select("user_id", hour).distinct()


@query(f"SELECT user_id, hour, min(hour) OVER (PARTITION BY user_id, run) AS first_seen FROM (SELECT *, hour - 3600 * row_number() OVER (PARTITION BY user_id ORDER BY hour) AS run FROM ({_SEEN}))")
def mempool_first_seen(L):
    """Each hourly snapshot's entries with the hour since which they have been there without a break."""
    return live.first_seen(seen(L), "user_id")


@query(f"""SELECT hour, count(*) AS n, CAST(coalesce(sum(fee), 0) AS BIGINT) AS fees, max(hour - first_seen) AS oldest_age FROM (
  {PLAIN_SQL["mempool_first_seen"]}) LEFT JOIN ptx ON txid = user_id GROUP BY hour""")
def mempool_fees(L):
    """Of each snapshot: entries, the fees of those that the ledger knows, and how long the oldest has waited."""
    rows = live.first_seen(seen(L), "user_id").join(ptx(L).select(F.col("txid").alias("user_id"), "fee"), "user_id", "left")
    return rows.groupBy("hour").agg(F.count("*").alias("n"), F.coalesce(wide("fee"), F.lit(0)).cast("long").alias("fees"), F.max(F.col("hour") - F.col("first_seen")).alias("oldest_age"))


@query("SELECT height - 1 AS height, interval AS age, interval // 60 AS minutes FROM gaps WHERE interval > 1200")
def frozen_tips(L):
    """Blocks that stayed the tip for longer than a watchdog allows, and how long its warning came to say."""
    return live.frozen_tips(L.block)


_BOUNDS = live.BOUNDS
_CUM = ", ".join(f"count(*) FILTER (value <= {b}) AS c{i}" for i, b in enumerate(_BOUNDS))
_RANK = "(0.95::DOUBLE * n)"
_STEPS = " ".join(
    f"WHEN c{i} >= {_RANK} THEN {lo}::DOUBLE + ({b}::DOUBLE - {lo}::DOUBLE) * ({_RANK} - {f'c{i - 1}' if i else '0'}) / (c{i} - {f'c{i - 1}' if i else '0'})" for i, (lo, b) in enumerate(zip((0.0, *_BOUNDS), _BOUNDS))
)
_P95 = f"""SELECT w AS start, event_type, n, CASE {_STEPS} ELSE {_BOUNDS[-1]}::DOUBLE END AS p95 FROM (SELECT w, event_type, count(value) AS n, {_CUM} FROM (
  SELECT event_type, value, unnest([CAST(floor(epoch(ts)) AS BIGINT) // 30 * 30 - 30 * k FOR k IN range(0, 10)]) AS w FROM events) GROUP BY w, event_type) WHERE n > 0"""


@query(f"SELECT start, event_type, n, round(p95, 6) AS p95 FROM ({_P95})")
def latency_quantiles(L):
    """The 95th percentile of each five-minute window, from counts by fixed bounds."""
    return live.bucket_quantiles(L.table("events"), 0.95).withColumn("p95", F.round("p95", 6))


@query(f"""SELECT event_type, "at" FROM (SELECT event_type, start + 30 * unnest(range(0, 7)) AS "at" FROM ({_P95}) WHERE p95 > 100) GROUP BY event_type, "at" HAVING count(*) = 7""")
def latency_alerts(L):
    """When the 95th percentile has been above 100 at every evaluation of three minutes."""
    high = live.bucket_quantiles(L.table("events"), 0.95).where("p95 > 100")
    return live.held_for(high, 180)


@query("""SELECT event_type, since, CAST(until AS BIGINT) AS until FROM (SELECT event_type, t AS since, lead(t) OVER (PARTITION BY event_type ORDER BY t) AS until FROM (
  SELECT DISTINCT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)) WHERE until - since >= 600""")
def stalled_metrics(L):
    """Stretches in which a metric's five-minute rate was 0 for five minutes."""
    return live.stalls(L.table("events"), 600)
