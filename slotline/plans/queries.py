"""The operators bound to the given tables, each with the SQL that must give the same rows.

Events stand for a chain: an hour is a block, "error" rows are keeper traffic, users are keys, (ts, event_id) is the order.
Orders and lineitems stand for transactions and legs; ledger words are made from table keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.functions import hexabi, u256
from slotline.operators import aggs, classify, extract, joins, merge, pages, reconcile, search, seq, upkeep
from slotline.sources.io import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def seconds(c: str):
    return F.unix_timestamp(c)


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("sec", seconds("ts").cast("bigint"))


def hours(s: SparkSession, d: str) -> DataFrame:
    """Block points: an hour with its first second, all rows, and rows that are no errors."""
    return events(s, d).groupBy(F.floor(F.col("sec") / 3600).alias("block")).agg(F.min("sec").alias("ts"), F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("app"))


SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
HOURS = f"p AS (SELECT CAST(floor({SEC} / 3600) AS BIGINT) AS block, min({SEC}) AS ts, count(*) AS total, count(*) FILTER (event_type <> 'error') AS app FROM events GROUP BY 1)"
W = 4
WINDOWS = f"""{HOURS}, w AS (SELECT first_value(block) OVER r AS from_block, block AS to_block, ts - first_value(ts) OVER r AS elapsed, CAST(sum(total) OVER r AS BIGINT) AS total, CAST(sum(app) OVER r AS BIGINT) AS app, count(*) OVER r AS n
FROM p WINDOW r AS (ORDER BY block ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
v AS (SELECT from_block, to_block, elapsed, total, app, total / elapsed AS total_tps, app / elapsed AS app_tps FROM w WHERE n = {W} AND elapsed >= 60)"""


@register("throughput_sliding_windows", f"WITH {WINDOWS} SELECT * FROM v")
def throughput_sliding_windows(s, d):
    return seq.sliding_windows(hours(s, d), W, 60)


@register("throughput_peak_window", f"WITH {WINDOWS} SELECT * FROM v ORDER BY total_tps DESC, from_block LIMIT 1")
def throughput_peak_window(s, d):
    return seq.peak_window(seq.sliding_windows(hours(s, d), W, 60))


@register("throughput_topk_disjoint", f"""WITH RECURSIVE {WINDOWS}, o AS (SELECT *, row_number() OVER (ORDER BY app_tps DESC, from_block) AS i FROM v),
g AS (SELECT i, from_block, to_block, 1 AS rank, [struct_pack(a := from_block, b := to_block)] AS used FROM o WHERE i = 1
UNION ALL SELECT n.i, n.from_block, n.to_block, g.rank + 1, list_append(g.used, struct_pack(a := n.from_block, b := n.to_block))
FROM g, LATERAL (SELECT * FROM o WHERE o.i > g.i AND len(list_filter(g.used, lambda x: NOT (o.to_block < x.a OR x.b < o.from_block))) = 0 ORDER BY o.i LIMIT 1) n WHERE g.rank < 10)
SELECT g.rank, o.from_block, o.to_block, o.elapsed, o.total, o.app, o.total_tps, o.app_tps FROM g JOIN o USING (i)""")
def throughput_topk_disjoint(s, d):
    return seq.topk_disjoint(seq.sliding_windows(hours(s, d), W, 60), 10, W)


@register("throughput_topk_blocks", f"WITH {HOURS} SELECT * FROM p ORDER BY app DESC, block LIMIT 100")
def throughput_topk_blocks(s, d):
    return seq.topk_blocks(hours(s, d), 100)


POINTS = "q AS (SELECT o_orderkey AS block, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, count(l_orderkey) AS total, count(*) FILTER (l_returnflag <> 'R') AS app FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def order_points(s, d):
    own = table(s, d, "orders").withColumn("sec", seconds("o_orderdate").cast("bigint"))
    return aggs.block_points(own, table(s, d, "lineitem"), "o_orderkey", "sec", F.col("l_returnflag") == "R", "l_orderkey")


@register("block_points", f"WITH {POINTS} SELECT * FROM q")
def block_points(s, d):
    return order_points(s, d)


@register("block_histogram", f"WITH {POINTS} SELECT CASE WHEN total <= 0 THEN '0' WHEN total = 1 THEN '1' WHEN total <= 5 THEN '2-5' WHEN total <= 20 THEN '6-20' WHEN total <= 50 THEN '21-50' ELSE '50+' END AS bucket, count(*) AS blocks FROM q GROUP BY 1")
def block_histogram(s, d):
    return aggs.block_histogram(order_points(s, d))


@register("throughput_merge_histogram", f"WITH {POINTS} SELECT CASE WHEN total <= 0 THEN '0' WHEN total = 1 THEN '1' WHEN total <= 5 THEN '2-5' WHEN total <= 20 THEN '6-20' WHEN total <= 50 THEN '21-50' ELSE '50+' END AS bucket, CAST(count(*) AS BIGINT) AS blocks FROM q GROUP BY 1")
def throughput_merge_histogram(s, d):
    p = order_points(s, d)
    return seq.merge_histogram(aggs.block_histogram(p.where("block % 3 = 0")), aggs.block_histogram(p.where("block % 3 <> 0")), "bucket", "blocks")


@register("timeseries", f"WITH {POINTS} SELECT ts // 604800 * 604800 AS bucket, count(*) AS blocks, CAST(sum(total) AS BIGINT) AS txs FROM q GROUP BY 1")
def timeseries(s, d):
    return aggs.timeseries(order_points(s, d), "ts", 604800)


@register("cadence", f"WITH {POINTS} SELECT count(*) FILTER (total > 0) AS filled, count(*) AS blocks, max(block) - min(block) AS slot_span, max(ts) - min(ts) AS time_span FROM q")
def cadence(s, d):
    return aggs.cadence(order_points(s, d), "block", "ts")


@register("top_blocks", "SELECT l_orderkey AS block, count(*) AS txs FROM lineitem GROUP BY 1 ORDER BY txs DESC, block DESC LIMIT 20")
def top_blocks(s, d):
    return aggs.top_blocks(table(s, d, "lineitem"), "l_orderkey", 20)


@register("current_tps", f"SELECT count(*) / 86400 AS tps, count(*) FILTER (event_type <> 'error') / 86400 AS app_tps FROM events WHERE {SEC} > (SELECT max({SEC}) FROM events) - 86400")
def current_tps(s, d):
    return aggs.current_rate(events(s, d), "sec", F.col("event_type") == "error", 86400)


@register("block_list", "SELECT o_orderkey AS block, o_orderstatus AS status, c.txs, c.qty AS gas, c.a AS n_a, c.r AS n_r FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS txs, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey")
def block_list(s, d):
    own = table(s, d, "orders").select(F.col("o_orderkey").alias("block"), F.col("o_orderstatus").alias("status"))
    legs = table(s, d, "lineitem").select(F.col("l_orderkey").alias("block"), "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return aggs.block_list(own, legs, "block", "l_returnflag", ["A", "R"], "q").select("block", "status", "txs", "gas", F.col("kinds.A").alias("n_a"), F.col("kinds.R").alias("n_r"))


@register("address_stats", "SELECT address, count(DISTINCT l_orderkey) AS txs, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM (SELECT l_orderkey, l_shipdate, unnest(list_distinct([l_partkey, l_suppkey])) AS address FROM lineitem) GROUP BY 1")
def address_stats(s, d):
    return aggs.address_stats(table(s, d, "lineitem"), "l_orderkey", "l_shipdate", ["l_partkey", "l_suppkey"])


@register("stats_overview", """WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM orders), b AS (SELECT coalesce(max(k), 0) AS latest_block, coalesce(max(k // 8), 0) AS latest_slot, count(*) AS txs, count(*) FILTER (ts > 870000000) / 30000000 AS tps, count(DISTINCT CASE WHEN k % 6 < 2 AND k % 4 <> 1 THEN CASE WHEN k % 3 <> 0 THEN c ELSE c + 1 END END) AS synthetics FROM t),
a AS (SELECT count(*) AS addresses, count(*) FILTER (c_custkey % 3 = 0 AND c_custkey % 7 > 0) AS contracts FROM customer), p AS (SELECT count(*) AS tokens, count(*) FILTER (p_partkey % 4 = 0) AS erc20, count(*) FILTER (p_partkey % 4 = 1) AS spl, count(*) FILTER (p_partkey % 4 = 2) AS token2022 FROM part)
SELECT *, greatest(0, addresses - contracts - synthetics) AS plain, (SELECT max(r_regionkey) FROM region WHERE r_regionkey < 3) AS source_max_slot FROM b, a, p""")
def stats_overview(s, d):
    from slotline.plans.chain import txs

    c, p = F.col("c_custkey"), F.col("p_partkey")
    x = txs(s, d)
    addresses = table(s, d, "customer").select(c.alias("address"), F.when(c % 7 != 0, c % 3 == 0).alias("is_contract"))
    tokens = table(s, d, "part").select(F.when(p % 4 == 0, "ERC-20").when(p % 4 == 1, "SPL").when(p % 4 == 2, "Token-2022").alias("kind"))
    cursors = table(s, d, "region").select(F.when(F.col("r_regionkey") < 3, "eth_block").otherwise("evm_tx").alias("table_name"), F.col("r_regionkey").alias("source_max_slot"))
    return aggs.stats_overview(x.select(F.col("k").alias("block"), F.col("slot_number").alias("slot"), "ts"), x, addresses, tokens, cursors, F.lit(900_000_000), 30_000_000)


@register("audit_event_counts", "SELECT event_type, user_id % 10 AS kind, count(*) AS n FROM events GROUP BY ALL")
def audit_event_counts(s, d):
    return aggs.event_counts(table(s, d, "events").withColumn("kind", F.col("user_id") % 10), ["event_type", "kind"])


@register("slot_digest", "SELECT c_nationkey AS slot, list_sort(list(DISTINCT c_mktsegment)) AS hashes, count(*) AS txs FROM customer GROUP BY 1")
def slot_digest(s, d):
    got = aggs.slot_digest(table(s, d, "customer").withColumn("idx", F.col("c_custkey") % 3), "c_nationkey", "c_mktsegment", "idx")
    return got.select(F.col("c_nationkey").alias("slot"), "hashes", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("txs"))


@register("block_frontier", "SELECT max(o_orderkey) AS block_frontier, min(o_orderkey) AS min_produced, max_by(o_custkey, o_orderkey) AS frontier_slot, min_by(o_custkey, o_orderkey) AS first_slot FROM orders")
def block_frontier(s, d):
    return aggs.frontier(table(s, d, "orders"), "o_orderkey", "o_custkey")


@register("candidate_pairs", "SELECT DISTINCT a AS token, b AS holder FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem UNION SELECT o_custkey, o_orderkey FROM orders)")
def candidate_pairs(s, d):
    return aggs.candidate_pairs(table(s, d, "lineitem").select(F.col("l_partkey").alias("token"), F.col("l_suppkey").alias("holder")), table(s, d, "orders").select("o_custkey", "o_orderkey"))


@register("holders_page", "SELECT *, CASE WHEN t > 0 THEN bal / t END AS share FROM (SELECT c_nationkey AS token, c_custkey AS holder, CAST(round(c_acctbal * 100) AS BIGINT) AS bal, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_custkey) AS rank, CAST(sum(greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0)) OVER (PARTITION BY c_nationkey) AS BIGINT) AS t FROM customer) WHERE rank <= 5")
def holders_page(s, d):
    b = table(s, d, "customer").select(F.col("c_nationkey").alias("token"), F.col("c_custkey").alias("holder"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("bal"))
    t = b.groupBy("token").agg(F.sum(F.greatest("bal", F.lit(0))).alias("t"))
    limbs = b.withColumn("balance", u256.normalise(u256.from_long(F.col("bal"))))
    return aggs.holders_page(limbs, 5).join(t, "token", "left").select("token", "holder", "bal", "rank", "t", "share")


def transfer_logs(s, d):
    """Result rows whose logs are made from lineitem keys: part pays supplier the order's number times 2**64 plus one."""
    topic = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 64, "0"))
    data = F.concat(F.lit("0x"), F.lpad(F.concat(F.lower(F.hex("l_orderkey")), F.lit("0" * 15 + "1")), 64, "0"))
    log = F.struct(F.lit("0xAA").alias("address"), F.array(F.lit(classify.TRANSFER), topic(F.col("l_partkey")), topic(F.col("l_suppkey"))).alias("topics"), data.alias("data"))
    noise = F.struct(F.lit("0xbb").alias("address"), F.array(F.lit(classify.APPROVAL), topic(F.col("l_partkey"))).alias("topics"), F.lit("0x").alias("data"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.struct(F.array(noise, log).alias("logs"))).alias("result"))


@register("extract_transfers", "SELECT l_orderkey, l_linenumber, 1 AS log_index, '0xaa' AS token, '0x' || lpad(lower(to_hex(l_partkey)), 40, '0') AS sender, '0x' || lpad(lower(to_hex(l_suppkey)), 40, '0') AS receiver, CAST(CAST(l_orderkey AS HUGEINT) * 18446744073709551616 + 1 AS VARCHAR) AS amount FROM lineitem")
def extract_transfers(s, d):
    return extract.extract_transfers(transfer_logs(s, d), ["l_orderkey", "l_linenumber"], "result").withColumn("amount", u256.to_string(F.col("amount")))


BALANCES = "WITH m AS (SELECT l_partkey AS h, -(CAST(l_orderkey AS HUGEINT) * 18446744073709551616 + 1) AS x FROM lineitem UNION ALL SELECT l_suppkey, CAST(l_orderkey AS HUGEINT) * 18446744073709551616 + 1 FROM lineitem), b AS (SELECT h, CAST(sum(x) AS HUGEINT) AS x FROM m WHERE h <> 0 GROUP BY h HAVING sum(x) <> 0)"


@register("token_balances", f"{BALANCES} SELECT '0xaa' AS token, '0x' || lpad(lower(to_hex(h)), 40, '0') AS holder, CAST(x AS VARCHAR) AS balance FROM b")
def token_balances(s, d):
    t = extract.extract_transfers(transfer_logs(s, d), ["l_orderkey", "l_linenumber"], "result")
    return aggs.token_balances(t, "token", "sender", "receiver", "amount", hexabi.ZERO_ADDRESS).withColumn("balance", u256.to_string(F.col("balance")))


@register("holder_counts", f"{BALANCES} SELECT '0xaa' AS token, count(*) AS holders FROM b WHERE x > 0")
def holder_counts(s, d):
    t = extract.extract_transfers(transfer_logs(s, d), ["l_orderkey", "l_linenumber"], "result")
    return aggs.holder_counts(aggs.token_balances(t, "token", "sender", "receiver", "amount", hexabi.ZERO_ADDRESS))


@register("decode_events", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'short_data' WHEN l_linenumber = 2 THEN 'topic_count' ELSE NULL END AS reason, CASE WHEN l_linenumber > 2 THEN CAST(l_suppkey AS VARCHAR) END AS n FROM lineitem")
def decode_events(s, d):
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    topics = F.array(F.lit("0x01"), F.concat(F.lit("0x"), hexed("l_partkey", 64)))
    logs = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("token").alias("source_kind"), F.when(F.col("l_linenumber") == 2, F.slice(topics, 1, 1)).otherwise(topics).alias("topics"), F.concat(F.lit("0x"), F.when(F.col("l_linenumber") == 1, "00").otherwise(hexed("l_suppkey", 64))).alias("data"))
    registry = s.createDataFrame([("token", "0x01", "Moved", "primary", [("who", "address", True), ("n", "uint256", False)])], "source_kind string, topic0 string, event_name string, tag string, args array<struct<name:string,type:string,indexed:boolean>>")
    return extract.decode_events(logs, registry).select("l_orderkey", "l_linenumber", "reason", F.conv(F.substring(F.try_element_at("decoded", F.lit("n")), 3, 64), 16, 10).alias("n"))


ACTIONS = "CASE l_linenumber WHEN 1 THEN ['contract_creation'] WHEN 2 THEN ['lend_supply', 'token_transfer'] WHEN 3 THEN ['swap', 'token_mint'] WHEN 4 THEN ['coin_transfer'] WHEN 5 THEN ['solana_cpi', 'token_approval'] ELSE ['empty_call'] END"


def feed(s, d):
    n = F.col("l_linenumber")
    log = lambda *t: F.struct(F.array(*[F.lit(x) for x in t]).alias("topics"))
    one = "0x" + "0" * 63 + "1"
    logs = F.when(n == 2, F.array(log(classify.TRANSFER, one, one), log(classify.TRANSFER, one, one))).when(n == 3, F.array(log(classify.SWAPS[0]), log(classify.TRANSFER, classify.ZERO_TOPIC, one)))
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("Rhea").alias("tx_type"), F.when(n == 2, "supply(address,uint256)").when(n == 5, "approve(address,uint256)").otherwise("0x").alias("method"), F.when(n > 1, F.when(n == 5, hexabi.CPI).otherwise("0xdd")).alias("to_addr"),
        F.when(n == 4, "10").otherwise("0").alias("value_wei"), F.lit(2).alias("tx_type_byte"), F.lit(0).alias("leg_count"), logs.alias("logs"), F.when(n == 1, 5).otherwise(0).alias("input_len"),
        F.when(F.col("l_orderkey") % 2 == 0, "solana_unsigned").otherwise("ecdsa").alias("origination"), F.lit(None).cast("string").alias("solana_signer"), F.lit(False).alias("has_cpi_target"), F.when(n == 2, hexabi.ORACLE_SELECTORS[0]).when(n == 3, "0x00").alias("method_id"),
    )


@register("action_tags", f"SELECT l_orderkey, l_linenumber, {ACTIONS} AS tags FROM lineitem")
def action_tags(s, d):
    return classify.tagged(feed(s, d)).select("l_orderkey", "l_linenumber", "tags")


@register("crossings", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 AND l_orderkey % 2 = 0 THEN ['evm_to_sol', 'sol_to_evm'] WHEN l_linenumber = 5 THEN ['evm_to_sol'] ELSE ['sol_to_evm'] END AS seams, l_linenumber = 2 AS is_oracle FROM lineitem WHERE l_linenumber = 5 OR l_orderkey % 2 = 0")
def crossings(s, d):
    return classify.crossings(feed(s, d), ["l_orderkey", "l_linenumber"])


@register("member_intervals", f"""WITH e AS (SELECT user_id, {SEC} AS sec, event_id, event_type = 'signup' AS f FROM events WHERE event_type IN ('signup', 'error')),
l AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY sec, event_id), false) AS was FROM e), t AS (SELECT * FROM l WHERE f <> was),
n AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS nxt FROM t) SELECT user_id, event_id AS from_id, nxt AS to_id FROM n WHERE f""")
def member_intervals(s, d):
    own = events(s, d).where(F.col("event_type").isin("signup", "error"))
    return seq.member_intervals(own, ["user_id"], ["sec", "event_id"], F.col("event_type") == "signup").select("user_id", F.col("from_pos.event_id").alias("from_id"), F.col("to_pos.event_id").alias("to_id"))


STATES = f"""e AS (SELECT user_id, {SEC} AS sec, event_id, event_type = 'click' AS f FROM events WHERE event_type IN ('click', 'view')),
l AS (SELECT *, lag(f) OVER w AS was FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)), t AS (SELECT * FROM l WHERE was IS NULL OR f <> was),
g AS (SELECT user_id, f AS state, event_id AS from_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS to_id, sec AS from_sec, lead(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS to_sec FROM t)"""


def gates(s, d):
    own = events(s, d).where(F.col("event_type").isin("click", "view"))
    return seq.state_intervals(own, ["user_id"], ["sec", "event_id"], F.col("event_type") == "click")


@register("state_intervals", f"WITH {STATES} SELECT user_id, state, from_id, to_id FROM g")
def state_intervals(s, d):
    return gates(s, d).select("user_id", "state", F.col("from_pos.event_id").alias("from_id"), F.col("to_pos.event_id").alias("to_id"))


@register("as_of_position", f"WITH {STATES} SELECT p.event_id, coalesce(g.state, false) AS state FROM events p LEFT JOIN g ON p.user_id = g.user_id AND ({SEC.replace('ts', 'p.ts')}, p.event_id) >= (g.from_sec, g.from_id) AND (g.to_id IS NULL OR ({SEC.replace('ts', 'p.ts')}, p.event_id) < (g.to_sec, g.to_id)) WHERE p.event_type = 'purchase'")
def as_of_position(s, d):
    points = events(s, d).where("event_type = 'purchase'").select("user_id", F.struct("sec", "event_id").alias("pos"), "event_id")
    return joins.as_of(points, gates(s, d), ["user_id"], "pos", "state", False).select("event_id", "state")


@register("epoch_intervals", f"""WITH e AS (SELECT user_id, {SEC} AS sec, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 7 + event_id % 5 END AS m FROM events WHERE event_type IN ('signup', 'error', 'purchase')),
n AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS to_id FROM e) SELECT user_id, m AS module, event_id AS from_id, to_id FROM n WHERE m IS NOT NULL""")
def epoch_intervals(s, d):
    own = events(s, d).where(F.col("event_type").isin("signup", "error", "purchase"))
    module = F.when(F.col("event_type") != "error", F.col("user_id") % 7 + F.col("event_id") % 5)
    return seq.epoch_intervals(own, ["user_id"], ["sec", "event_id"], module).select("user_id", "module", F.col("from_pos.event_id").alias("from_id"), F.col("to_pos.event_id").alias("to_id"))


@register("set_history", "SELECT o_custkey, o_orderstatus AS value, o_orderkey AS from_pos, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS to_pos FROM orders")
def set_history(s, d):
    return seq.set_history(table(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus")


@register("change_chain", "SELECT o_custkey, o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_orderstatus AS after FROM orders")
def change_chain(s, d):
    return seq.change_chain(table(s, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus")


@register("lifo_pair", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'view' AS o, row_number() OVER (PARTITION BY user_id ORDER BY {SEC}, event_id) AS i FROM events WHERE event_type IN ('view', 'purchase')),
r AS (SELECT user_id, i, event_id, o, CASE WHEN o THEN [event_id] ELSE CAST([] AS BIGINT[]) END AS st, CAST(NULL AS BIGINT) AS m FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, e.event_id, e.o, CASE WHEN e.o THEN list_append(r.st, e.event_id) WHEN len(r.st) = 0 THEN r.st ELSE r.st[:-2] END, CASE WHEN NOT e.o AND len(r.st) > 0 THEN r.st[-1] END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id AS close_id, m AS open_id FROM r WHERE NOT o""")
def lifo_pair(s, d):
    return seq.lifo_pair(events(s, d), ["user_id"], ["sec", "event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase", "event_id")


@register("yield_runs", f"""WITH e AS (SELECT user_id, event_id, event_type, {SEC} AS sec, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY {SEC}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events WHERE event_type IN ('view', 'purchase')),
g AS (SELECT user_id, CAST(run AS BIGINT) AS run, count(*) FILTER (event_type = 'view') AS credits, CAST(coalesce(sum(event_id % 100) FILTER (event_type = 'view'), 0) AS BIGINT) AS credited, max(event_id % 1000) FILTER (event_type = 'purchase') AS stated, count(*) FILTER (event_type = 'purchase') AS closes FROM e GROUP BY 1, 2)
SELECT user_id, run, credits, credited, stated, closes > 0 AS closed, stated - credited AS remainder, coalesce(stated - credited < 0, false) AS over_credit FROM g WHERE closes > 0 OR credits > 0""")
def yield_runs(s, d):
    own = events(s, d).where(F.col("event_type").isin("view", "purchase"))
    return seq.yield_runs(own, ["user_id"], ["sec", "event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase", F.col("event_id") % 100, F.col("event_id") % 1000)


@register("running_balance", """WITH t AS (SELECT o_custkey AS p, o_orderkey % 50 AS q, o_orderkey // 100 AS block, CAST(round(o_totalprice * 100) AS BIGINT) AS d FROM orders WHERE o_orderkey % 11 <> 0), m AS (SELECT p AS a, block, -d AS d FROM t UNION ALL SELECT q, block, d FROM t), b AS (SELECT a, block, CAST(sum(d) AS HUGEINT) AS d FROM m WHERE a <> 0 GROUP BY 1, 2)
SELECT '0x' || lpad(lower(to_hex(a)), 40, '0') AS address, block, CAST(sum(d) OVER w AS VARCHAR) AS balance, sum(d) OVER w < 0 AS alarm FROM b WINDOW w AS (PARTITION BY a ORDER BY block)""")
def running_balance(s, d):
    from slotline.plans.chain import hx

    o = F.col("o_orderkey")
    amount = F.when(o % 11 != 0, u256.from_long(F.round(F.col("o_totalprice") * 100).cast("bigint")))
    own = table(s, d, "orders").select(hx(F.col("o_custkey"), 40).alias("payer"), hx(o % 50, 40).alias("payee"), F.floor(o / 100).alias("block"), amount.alias("amount"))
    return seq.running_balance(own, "payer", "payee", "block", "amount").withColumn("balance", u256.to_string(F.col("balance")))


ZERO = "'0'"


@register("exposure_windows", f"""WITH {STATES}, x AS (SELECT *, max(CAST(state AS INT)) OVER (PARTITION BY user_id ORDER BY from_sec, from_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gated FROM g),
sp AS (SELECT user_id, from_sec, from_id, to_sec, to_id FROM x WHERE NOT state AND gated = 1),
tr AS (SELECT user_id, {SEC} AS sec, event_id, CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN 's' END AS f, CAST(event_id % 4 AS VARCHAR) AS t FROM events WHERE event_type = 'purchase'),
j AS (SELECT sp.user_id, sp.from_id, sp.to_id, tr.event_id, coalesce(f, '?') AS f, t FROM sp LEFT JOIN tr ON tr.user_id = sp.user_id AND (tr.sec, tr.event_id) >= (sp.from_sec, sp.from_id) AND (sp.to_id IS NULL OR (tr.sec, tr.event_id) < (sp.to_sec, sp.to_id))),
a AS (SELECT user_id, from_id, to_id, count(*) FILTER (f = {ZERO} AND t <> {ZERO}) AS mints, count(*) FILTER (t = {ZERO} AND f <> {ZERO}) AS burns, count(*) FILTER (event_id IS NOT NULL AND f <> {ZERO} AND t <> {ZERO}) AS third_party, coalesce(list_sort(list(event_id) FILTER (event_id IS NOT NULL AND f <> {ZERO} AND t <> {ZERO})), []) AS third_ids, coalesce(list_sort(list(DISTINCT t) FILTER (f <> {ZERO} AND t <> {ZERO} AND t <> '1')), []) AS never_listed FROM j GROUP BY 1, 2, 3)
SELECT *, CASE WHEN third_party > 0 THEN 'OTHER' WHEN mints > 0 AND burns > 0 THEN 'CLAWBACK' WHEN mints > 0 THEN 'ISSUANCE' ELSE 'OTHER' END AS kind FROM a""")
def exposure_windows(s, d):
    e = F.col("event_id")
    moves = events(s, d).where("event_type = 'purchase'").select("user_id", F.struct("sec", "event_id").alias("pos"), F.when(e % 3 == 0, "0").when(e % 3 == 1, "s").alias("sender"), (e % 4).cast("string").alias("receiver"))
    listed = events(s, d).select("user_id", F.lit("1").alias("address")).distinct()
    out = seq.exposure_windows(gates(s, d), moves, listed, ["user_id"], "0")
    return out.select("user_id", F.col("from_pos.event_id").alias("from_id"), F.col("to_pos.event_id").alias("to_id"), "mints", "burns", "third_party", F.array_sort(F.transform("third_party_positions", lambda p: p["event_id"])).alias("third_ids"), "never_listed", "kind")


@register("numbers_contiguity", "SELECT after, before FROM (SELECT l_orderkey AS after, lead(l_orderkey) OVER (ORDER BY l_orderkey) AS before FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 3)) WHERE before - after > 1")
def numbers_contiguity(s, d):
    return seq.contiguity(table(s, d, "lineitem").where("l_linenumber = 3"), "l_orderkey")


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def halves(s, d):
    """An older table, and a batch that overlaps it with changed statuses."""
    o = table(s, d, "orders").select(*ORDERS)
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit("*")))


OLD, NEW = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0)", "n AS (SELECT o_orderkey, o_custkey, o_orderstatus || '*' AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)"


@register("scan_after", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 5000")
def scan_after(s, d):
    return merge.scan_after(table(s, d, "orders"), "o_orderkey", 100, 5000).select("o_orderkey", "o_custkey")


@register("scan_after_null_wall", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 997 = 996)")
def scan_after_null_wall(s, d):
    own = table(s, d, "orders").withColumn("p", F.when(F.col("o_orderkey") % 997 != 996, F.col("o_custkey")))
    return merge.scan_after_null_wall(own, "o_orderkey", "p").select("o_orderkey", "o_custkey")


@register("defer_open_group", "WITH p AS (SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2 LIMIT 1000) SELECT *, false AS single_group FROM p WHERE l_orderkey < (SELECT max(l_orderkey) FROM p)")
def defer_open_group(s, d):
    return merge.defer_open_group(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 1000, ["l_linenumber"])


@register("distinct_on", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def distinct_on(s, d):
    return merge.distinct_on(table(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@register("dedupe_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def dedupe_last(s, d):
    return merge.dedupe_last(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@register("insert_ignore", f"WITH {OLD}, {NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def insert_ignore(s, d):
    return merge.insert_ignore(*halves(s, d), ["o_orderkey"])


@register("upsert_changed", f"WITH {OLD}, {NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(o.o_orderpriority, n.o_orderpriority) AS o_orderpriority FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def upsert_changed(s, d):
    return merge.upsert_changed(*halves(s, d), ["o_orderkey"], ["o_orderstatus"])


@register("upsert_merge", f"WITH {OLD}, {NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey + n.o_custkey, o.o_custkey, n.o_custkey) AS o_custkey, least(o.o_orderstatus, n.o_orderstatus) AS o_orderstatus, coalesce(o.o_orderpriority, n.o_orderpriority) AS o_orderpriority FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def upsert_merge(s, d):
    return merge.upsert_merge(*halves(s, d), ["o_orderkey"], {"o_custkey": "add", "o_orderstatus": "least"})


RANKS = "CASE {}.o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END"


@register("upsert_ranked", f"WITH {OLD}, n AS (SELECT o_orderkey, o_custkey, o_orderstatus || '*' AS o_orderstatus, '2-HIGH' AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0), j AS (SELECT o, n, n.o_orderkey IS NOT NULL AND (o.o_orderkey IS NULL OR 2 >= {RANKS.format('o')}) AS w FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN w THEN n.o_custkey ELSE o.o_custkey END AS o_custkey, CASE WHEN w THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, CASE WHEN w THEN n.o_orderpriority ELSE o.o_orderpriority END AS o_orderpriority FROM j")
def upsert_ranked(s, d):
    old, new = halves(s, d)
    rank = lambda r: F.when(r["o_orderpriority"] == "1-URGENT", 3).when(r["o_orderpriority"] == "2-HIGH", 2).otherwise(1)
    return merge.upsert_ranked(old, new.withColumn("o_orderpriority", F.lit("2-HIGH")), ["o_orderkey"], rank)


@register("inserted_count", f"WITH {OLD}, {NEW} SELECT o_orderpriority, count(*) AS inserted FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o) GROUP BY 1")
def inserted_count(s, d):
    return merge.inserted_count(*halves(s, d), ["o_orderkey"], ["o_orderpriority"])


@register("slot_density", "SELECT count(*) / greatest(count(DISTINCT l_orderkey), 1) AS density FROM lineitem WHERE l_orderkey > 100 AND l_orderkey <= 1100")
def slot_density(s, d):
    return merge.slot_density(table(s, d, "lineitem"), "l_orderkey", 100, 1000)


@register("source_lag", "WITH m AS (SELECT o_orderpriority, max(o_orderkey) AS source_max FROM orders GROUP BY 1), c AS (SELECT DISTINCT o_orderpriority, 100 AS cursor FROM orders UNION ALL SELECT 'none', 100) SELECT c.*, source_max, source_max - cursor AS lag FROM c LEFT JOIN m USING (o_orderpriority)")
def source_lag(s, d):
    o = table(s, d, "orders")
    c = o.select("o_orderpriority").distinct().unionByName(o.sparkSession.createDataFrame([("none",)], "o_orderpriority string")).withColumn("cursor", F.lit(100))
    return merge.source_lag(c, o, "o_orderpriority", "cursor", "o_orderkey")


@register("batch_announce", "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS n_app, max_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'F') AS last_app FROM orders GROUP BY 1")
def batch_announce(s, d):
    return merge.batch_announce(table(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority", F.col("o_orderstatus") == "F")


@register("append_only_check", f"WITH {OLD}, {NEW} SELECT * FROM o EXCEPT ALL (SELECT * FROM n)")
def append_only_check(s, d):
    return merge.append_only_check(*halves(s, d))


@register("delete_scope", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)")
def delete_scope(s, d):
    return merge.delete_scope(table(s, d, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0)).select("o_orderkey")


@register("anti_unlabelled", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_unlabelled(s, d):
    return joins.anti(table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus"), ["c_custkey"], F.col("o_orderstatus") == "F")


@register("semi_contract_signal", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def semi_contract_signal(s, d):
    return joins.semi_signal(table(s, d, "customer"), "c_custkey", table(s, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"), table(s, d, "supplier").select("s_suppkey")).select("c_custkey")


@register("lateral_first", "SELECT c_custkey, (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1) AS first_status FROM customer")
def lateral_first(s, d):
    side = table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.attach_first(table(s, d, "customer"), side, ["c_custkey"], "o_orderstatus", "o_orderkey", "first_status").select("c_custkey", "first_status")


@register("attach_hooks", "SELECT o_orderkey, coalesce(l.hooks, []) AS hooks FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(l_linenumber * 10 + l_suppkey % 10)) AS hooks FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey")
def attach_hooks(s, d):
    side = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("h"))
    return joins.attach_list(table(s, d, "orders").select("o_orderkey"), side, ["o_orderkey"], ["h"], "hooks").withColumn("hooks", F.transform("hooks", lambda x: x["h"]))


@register("address_txs", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7 ORDER BY 1 DESC, 2 DESC LIMIT 25")
def address_txs(s, d):
    own = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.touching(own, ["l_partkey", "l_suppkey"], 7, [F.desc("l_orderkey"), F.desc("l_linenumber")], 25)


@register("keyset_page", "SELECT o_orderkey, o_custkey, true AS has_more FROM orders WHERE (o_custkey, o_orderkey) < (50, 1000) ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 40")
def keyset_page(s, d):
    return pages.keyset_page(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], [50, 1000], 40)


@register("offset_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 30 OFFSET 20")
def offset_page(s, d):
    return pages.offset_page(table(s, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 20, 30)


@register("page_with_total", "SELECT c_custkey, c_name, c_mktsegment, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1') ORDER BY c_custkey LIMIT 15 OFFSET 5")
def page_with_total(s, d):
    own = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return pages.page_with_total(own, {"c_mktsegment": "BUILDING"}, "1", ["c_name"], ["c_custkey"], 5, 15)


TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
INDEX = "i AS (SELECT 'token' AS kind, CAST(p_partkey AS VARCHAR) AS key, p_name AS text, 80 AS weight FROM part UNION ALL SELECT 'address', CAST(c_custkey AS VARCHAR), c_name, 60 FROM customer UNION ALL SELECT 'block', CAST(s_suppkey AS VARCHAR), s_name, 90 FROM supplier)"


def index(s, d):
    own = lambda t, k, n: table(s, d, t).select(F.col(k).alias("key"), F.col(n).alias("text"))
    none = own("part", "p_partkey", "p_name").where("false")
    return search.search_index(none, own("supplier", "s_suppkey", "s_name"), own("part", "p_partkey", "p_name"), own("customer", "c_custkey", "c_name"), own("customer", "c_custkey", "c_name"))


@register("search_index", f"WITH {INDEX} SELECT * FROM i")
def search_index(s, d):
    return index(s, d)


@register("search_trigram", f"WITH {INDEX}, t AS (SELECT *, {TRI.format('text')} AS a, {TRI.format(chr(39) + 'Customer 000000012 steel' + chr(39))} AS b FROM i), s AS (SELECT kind, key, text, weight, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM t) SELECT *, similarity < 1 AS partial FROM s WHERE similarity > 0.05 ORDER BY similarity DESC, weight DESC, key LIMIT 20")
def search_trigram(s, d):
    return search.search(index(s, d), "Customer 000000012 steel")


@register("search_many", f"WITH {INDEX}, q AS (SELECT DISTINCT s_name AS query FROM supplier), t AS (SELECT query, kind, key, weight, {TRI.format('text')} AS a, {TRI.format('query')} AS b FROM i, q), s AS (SELECT query, kind, key, weight, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM t) SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, weight DESC, kind, key) AS rank, kind, key, similarity FROM s WHERE similarity > 0.05 QUALIFY rank <= 20")
def search_many(s, d):
    return search.search_many(index(s, d), table(s, d, "supplier").select(F.col("s_name").alias("query")))


@register("address_search", "SELECT c_custkey, address, label FROM (SELECT c_custkey, lower(to_hex(c_custkey)) AS address, c_name AS label FROM customer) WHERE starts_with(address, '1a') OR contains(lower(label), '1a')")
def address_search(s, d):
    own = table(s, d, "customer").select("c_custkey", F.lower(F.hex("c_custkey")).alias("address"), F.col("c_name").alias("label"))
    return search.address_search(own, "1a")


TEXT = "coalesce('\"' || {} || '\"', 'null')"


@register("evidence_hash", f"SELECT doc_id, sha256('{{\"doc_id\":' || doc_id || ',\"lang\":' || {TEXT.format('lang')} || ',\"source\":' || {TEXT.format('source')} || '}}') AS hash FROM documents")
def evidence_hash(s, d):
    return table(s, d, "documents").select("doc_id", hexabi.evidence_hash("doc_id", "lang", "source").alias("hash"))


NAMED = "CASE p_partkey % 8 WHEN 1 THEN 'Compound ' || p_name WHEN 2 THEN 'my COMET' WHEN 3 THEN 'aave' WHEN 4 THEN 'Uniswap V3 pool' WHEN 5 THEN 'uniswap v2' WHEN 6 THEN 'Uniswap' WHEN 7 THEN '' ELSE p_name END"
RULED = "CASE WHEN contains(n, 'compound') THEN 'Compound' WHEN contains(n, 'comet') THEN 'Comet' WHEN contains(n, 'aave') THEN 'Aave V3' WHEN contains(n, 'uniswap v3') THEN 'Uniswap V3' WHEN contains(n, 'uniswap v2') THEN 'Uniswap V2' WHEN contains(n, 'uniswap') THEN 'Uniswap' WHEN n = '' AND p_partkey % 3 = 0 THEN 'Uniswap V3' END"


@register("normalize_label", f"""WITH a AS (SELECT p_partkey, {NAMED} AS name, lower({NAMED}) AS n, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 5 = 1 THEN p_brand || '-a-long-symbol-text' ELSE p_brand END ELSE '' END AS symbol FROM part), b AS (SELECT *, {RULED} AS ruled, symbol <> '' AND strlen(symbol) <= 16 AS short FROM a)
SELECT p_partkey, coalesce(ruled, CASE WHEN short THEN symbol END, nullif(name, '')) AS label, CASE WHEN ruled IS NOT NULL THEN coalesce(nullif(symbol, ''), CASE WHEN name <> '' AND name <> ruled THEN name END) WHEN short OR name = '' THEN NULL ELSE nullif(symbol, '') END AS detail FROM b""")
def normalize_label(s, d):
    n, name = F.col("p_partkey"), F.col("p_name")
    named = F.when(n % 8 == 1, F.concat(F.lit("Compound "), name)).when(n % 8 == 2, "my COMET").when(n % 8 == 3, "aave").when(n % 8 == 4, "Uniswap V3 pool").when(n % 8 == 5, "uniswap v2").when(n % 8 == 6, "Uniswap").when(n % 8 == 7, F.when(n % 2 == 1, " ")).otherwise(name)
    symbol = F.when(n % 5 > 0, F.when(n % 5 == 1, F.concat("p_brand", F.lit("-a-long-symbol-text"))).otherwise(F.col("p_brand")))
    label, detail = hexabi.normalize_label(named, symbol, F.when(n % 3 == 0, "0x6080128acb08").otherwise("0x00"))
    return table(s, d, "part").select("p_partkey", label.alias("label"), detail.alias("detail"))


@register("address_kind", "SELECT c_custkey, CASE WHEN c_custkey = 0 THEN 'burn' WHEN c_custkey BETWEEN 1 AND 10 THEN 'precompile_eth' WHEN c_custkey % 5 = 0 THEN 'token' WHEN c_custkey % 5 = 1 THEN 'contract' WHEN c_custkey % 5 = 2 THEN 'account' ELSE 'eoa' END AS kind FROM customer")
def address_kind(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", hexabi.address_kind(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(k)), 40, "0")), k % 5 == 0, k % 5 == 1, k % 5 == 2).alias("kind"))


@register("format_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 0 THEN CAST(o_orderkey // 1000 AS VARCHAR) ELSE (o_orderkey // 1000) || '.' || regexp_replace(lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), '0+$', '') END AS amount FROM orders")
def format_amount(s, d):
    return table(s, d, "orders").select("o_orderkey", hexabi.format_amount(F.col("o_orderkey").cast("string"), F.lit(3)).alias("amount"))


@register("tx_status", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'success' ELSE 'success' END AS status FROM orders")
def tx_status(s, d):
    k = F.col("o_orderkey") % 4
    result = F.when(k == 1, '{"exit_reason":{"code":1,"reason":"Revert"}}').when(k == 2, '{"exit_reason":{"code":0}}').when(k == 3, '{"exit_reason":{"reason":"Succeed(Stopped)"}}')
    return table(s, d, "orders").select("o_orderkey", hexabi.tx_status(result).alias("status"))


@register("reconcile_transfers", f"WITH {OLD}, {NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderstatus AS stored, n.o_orderstatus AS fresh, CASE WHEN o.o_orderkey IS NULL THEN 'missing' WHEN n.o_orderkey IS NULL THEN 'unconfirmed' WHEN o.o_orderstatus = n.o_orderstatus THEN 'unchanged' ELSE 'healed' END AS status FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def reconcile_transfers(s, d):
    return reconcile.reconcile(*halves(s, d), ["o_orderkey"], "o_orderstatus")


@register("finality_watermark", f"""WITH a AS (SELECT {SEC} // 3600 AS h, count(*) AS n FROM events WHERE event_id % 911 <> 910 GROUP BY 1), b AS (SELECT {SEC} // 3600 AS h, count(*) AS n FROM events GROUP BY 1), t AS (SELECT max(h) AS tip FROM b)
SELECT coalesce(min(CASE WHEN tip - b.h < 24 OR a.n IS DISTINCT FROM b.n THEN b.h END), max(b.h) + 1) - 1 AS watermark FROM b LEFT JOIN a USING (h), t""")
def finality_watermark(s, d):
    digest = lambda e: e.groupBy(F.floor(F.col("sec") / 3600).alias("h")).agg(F.count("*").alias("n"))
    e = events(s, d)
    tip = digest(e).agg(F.max("h")).first()[0]
    return reconcile.finality_watermark(digest(e.where("event_id % 911 <> 910")), digest(e), "h", "n", tip or 0, tip or 0, 24)


@register("detect_gaps", "SELECT l_suppkey AS address, l_returnflag AS filter, min(l_orderkey) AS from_block, 5000 AS to_block FROM lineitem WHERE (l_suppkey, l_returnflag) NOT IN (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 0) GROUP BY 1, 2 HAVING min(l_orderkey) <= 5000")
def detect_gaps(s, d):
    own = table(s, d, "lineitem").select(F.col("l_suppkey").alias("address"), F.col("l_returnflag").alias("filter"), F.col("l_orderkey").alias("from_block"), "l_linenumber")
    return reconcile.detect_gaps(own.drop("l_linenumber"), own.where("l_linenumber = 1 AND from_block % 2 = 0").select("address", "filter").distinct(), 5000)


@register("throughput_merge_record", SQL["throughput_topk_disjoint"])
def throughput_merge_record(s, d):
    """The record of the first half of the hours, folded forward by the second, gives what all hours give."""
    points = hours(s, d)
    cursor = points.agg(F.floor((F.min("block") + F.max("block")) / 2)).first()[0]
    if cursor is None:
        return seq.topk_disjoint(seq.sliding_windows(points, W, 60), 10, W)
    record = upkeep.throughput_record(seq.sliding_windows(points.where(F.col("block") <= cursor), W, 60), 10, W)
    return seq.topk_disjoint(upkeep.merge_record(record, points, cursor, 10, W, 60), 10, W)


@register("recheck_window", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders) - 5000 AND o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def recheck_window(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    tip = o.agg(F.coalesce(F.max("o_orderkey"), F.lit(0))).first()[0]
    late = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return upkeep.recheck_window(o, late, ["o_orderkey"], "o_orderkey", tip, 5000, F.col("o_orderstatus") == "F")


@register("backfill_flag", "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS flag FROM orders")
def backfill_flag(s, d):
    marked = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return upkeep.backfill_flag(table(s, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("flag")), marked, ["o_orderkey"], "flag")


@register("backfill", "WITH g AS (SELECT user_id, min(event_id) + 10 AS a, max(event_id) - 10 AS b FROM events WHERE user_id % 5 = 0 GROUP BY 1) SELECT user_id, event_id, event_id % 2 = 0 AS filled FROM events e WHERE event_id % 2 = 1 OR EXISTS (SELECT 1 FROM g WHERE g.user_id = e.user_id AND e.event_id BETWEEN a AND b)")
def backfill(s, d):
    e = table(s, d, "events").select("user_id", "event_id")
    gaps = e.where("user_id % 5 = 0").groupBy("user_id").agg((F.min("event_id") + 10).alias("from_slot"), (F.max("event_id") - 10).alias("to_slot"))
    return upkeep.backfill(e.where("event_id % 2 = 1").withColumn("filled", F.lit(False)), gaps, e, "user_id", "event_id", ["event_id"], lambda x: x.withColumn("filled", F.lit(True)))


@register("pick_oldest_sane", "SELECT source, min_by(text, doc_id) AS text FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7f]*') AND length(text) <= 512 GROUP BY 1")
def pick_oldest_sane(s, d):
    return upkeep.pick_oldest_sane(table(s, d, "documents"), "source", "text", "doc_id")


@register("hook_count_check", "SELECT o_orderkey, coalesce(p, 0) AS parsed, o_orderkey % 7 + 1 AS stated FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(p, 0) <> o_orderkey % 7 + 1")
def hook_count_check(s, d):
    parsed = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return upkeep.count_check(parsed, table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("n")), ["o_orderkey"], "n")


@register("market_match", "SELECT o_orderkey AS market, c_custkey AS asset FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = l_partkey OR c_custkey = l_suppkey WHERE c_nationkey < 5")
def market_match(s, d):
    markets = table(s, d, "lineitem").select(F.col("l_orderkey").alias("market"), F.col("l_partkey").alias("loan"), F.col("l_suppkey").alias("collateral"))
    assets = table(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("asset"))
    return upkeep.market_match(table(s, d, "orders").select(F.col("o_orderkey").alias("market")), markets, assets).select("market", "asset")


@register("source_intervals", """WITH h AS (SELECT o_custkey AS asset, o_orderstatus AS role, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS address, o_orderkey AS from_pos, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS to_pos FROM orders)
SELECT * FROM h WHERE address IS NOT NULL UNION ALL SELECT c_custkey, 'F', c_mktsegment, NULL, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') FROM customer""")
def source_intervals(s, d):
    changes = table(s, d, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderstatus").alias("role"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("address"), F.col("o_orderkey").alias("position"))
    return upkeep.source_intervals(table(s, d, "customer").select(F.col("c_custkey").alias("asset"), F.lit("F").alias("role"), F.col("c_mktsegment").alias("address")), changes)


def stack_sql(name: str, src: str) -> str:
    """A stack per group g over (g, event_id, o), row by row; m is what a close takes."""
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) AS i FROM ({src})),
{name} AS (SELECT g, i, event_id, o, CASE WHEN o THEN [event_id] ELSE CAST([] AS BIGINT[]) END AS st, CAST(NULL AS BIGINT) AS m FROM {name}0 WHERE i = 1
UNION ALL SELECT e.g, e.i, e.event_id, e.o, CASE WHEN e.o THEN list_append(r.st, e.event_id) WHEN len(r.st) = 0 THEN r.st ELSE r.st[:-2] END, CASE WHEN NOT e.o AND len(r.st) > 0 THEN r.st[-1] END FROM {name} r JOIN {name}0 e ON e.g = r.g AND e.i = r.i + 1)"""


BOUGHT = "event_type = 'purchase' AND event_id % 7 <> 0 AND event_id % 4 <> 3"


@register("sales", f"""WITH RECURSIVE {stack_sql('t', f"SELECT user_id * 4 + event_id % 4 AS g, event_id, event_type = 'view' AS o FROM events WHERE event_type = 'view' OR ({BOUGHT})")},
{stack_sql('p', f"SELECT user_id AS g, event_id, event_type <> 'purchase' AS o FROM events WHERE event_type = 'click' OR ({BOUGHT})")}
SELECT t.event_id, t.m AS token_leg, p.m AS payment_leg FROM t JOIN p USING (event_id) WHERE NOT t.o AND NOT p.o""")
def sales(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.col("event_id").alias("log"), "event_type", (F.col("event_id") % 4).alias("asset"))
    bought = e.where("event_type = 'purchase'").select("user_id", "event_id", "log", F.col("asset").alias("token"), F.col("user_id").alias("buyer"), F.when(F.col("event_id") % 7 != 0, 1).alias("amount"), F.lit(1).alias("price_paid"))
    tokens = s.range(3).select(F.col("id").alias("token"), F.col("id").alias("asset"))
    return seq.sales(bought, e.where("event_type = 'view'"), e.where("event_type = 'click'"), tokens, ["user_id"], "log").select("event_id", "token_leg", "payment_leg")


@register("legs", "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS INTEGER) AS n, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END AS first_signature FROM orders")
def legs(s, d):
    o = table(s, d, "orders")
    built = hexabi.legs_build(F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), F.lit("main"), F.when(F.col("o_orderstatus") == "F", "Romulus").otherwise("Other"))
    return o.select("o_orderkey", hexabi.legs_parse(F.to_json(built)).alias("legs")).select("o_orderkey", F.size("legs").alias("n"), F.get("legs", F.lit(0))["sol_signature"].alias("first_signature"))


@register("u256_from_string", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey || repeat('0', 30) END AS amount FROM orders")
def u256_from_string(s, d):
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "0").otherwise(""), F.col("o_orderkey").cast("string"), F.lit("0" * 30))
    return table(s, d, "orders").select("o_orderkey", u256.to_string(u256.from_string(text)).alias("amount"))


@register("bytes32_to_base58")
def bytes32_to_base58(s, d):
    return table(s, d, "customer").select("c_custkey", hexabi.bytes32_to_base58(F.concat(F.lit("0x"), F.sha2(F.col("c_custkey").cast("string"), 256))).alias("key"))


from slotline.plans import more, rebuilds  # noqa: E402, F401  register their queries
