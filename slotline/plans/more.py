"""More operators bound to the given tables, over chain-shaped rows (see ``chain``), with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slotline.functions import hexabi, registry, u256
from slotline.operators import aggs, audit, classify, extract, joins, merge, pages, reconcile, rollup, search, seq
from slotline.plans.chain import AUDIT, GATES, TXS, ZERO, H, audit_events, hx, txs
from slotline.plans.queries import POINTS, SEC, W, events, gates, order_points, register, stack_sql, transfer_logs
from slotline.sources import buckets
from slotline.sources.io import large_rows, scratch, table, written
from slotline.streaming import streams



# ---- scalar functions


@register("abi_words", f"""SELECT k, CASE WHEN k % 3 <> 0 THEN {H('k', 40)} END AS strict_address, CASE WHEN k % 2 = 0 THEN '' ELSE {H('k', 40)} END AS loose_address, k % 4 > 0 AS loose_bool, CASE WHEN k % 4 < 2 THEN k % 4 = 1 END AS strict_bool,
CASE WHEN k % 5 <> 0 THEN o_orderpriority END AS text FROM (SELECT o_orderkey AS k, o_orderpriority FROM orders)""")
def abi_words(s, d):
    k = F.col("k")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    word = F.when(k % 3 == 0, F.concat(F.lit("0xff"), F.substring(hx(k, 64), 5, 62))).otherwise(hx(k, 64))
    body = F.lower(F.hex(F.encode("o_orderpriority", "UTF-8")))
    data = F.concat(hx(F.lit(32), 64), F.substring(hx(F.octet_length("o_orderpriority").cast("bigint"), 64), 3, 64), F.when(k % 5 == 0, F.substring(body, 1, 4)).otherwise(F.rpad(body, 64, "0")))
    return o.select("k", hexabi.topic_to_address(word, True).alias("strict_address"), hexabi.topic_to_address(F.when(k % 2 == 0, "0x12").otherwise(hx(k, 64))).alias("loose_address"), hexabi.bool_word(hx(k % 4, 64)).alias("loose_bool"), hexabi.bool_word(hx(k % 4, 64), True).alias("strict_bool"), hexabi.abi_string(data).alias("text"))


@register("gas_report", """SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS gas_used, CASE WHEN o_orderkey % 3 <> 0 THEN '1000000000000000000' END AS gas_price, '0xab' AS gas_recipient, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 100 END AS VARCHAR) AS priority_fee,
CASE WHEN o_orderkey % 3 <> 0 THEN CAST(greatest(0, CAST(o_orderkey AS HUGEINT) * 1000000000000000000 - CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 100 END) AS VARCHAR) END AS base_fee, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS held FROM orders""")
def gas_report(s, d):
    k = F.col("k")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    used = F.when(k % 2 == 0, hx(k, 1 + 10)).otherwise(k.cast("string"))
    inner = F.struct(used.alias("gas_value"), F.when(k % 3 != 0, "1000000000000000000").alias("gas_price"), F.lit("0xAB").alias("gas_recipient"), F.when(k % 4 != 0, (k % 100).cast("string")).alias("priority_fee"))
    got = hexabi.gas_report(F.to_json(F.struct(inner.alias("gas_report"))))
    return o.select("k", *[(c if n == "gas_recipient" else c.cast("string")).alias(n) for n, c in got.items()], hexabi.number_or_hex(F.when(k % 2 == 0, hx(k, 12)).otherwise("x")).alias("held"))


@register("chain_times", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(make_timestamp(o_orderkey * 10000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS iso, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 THEN (o_orderkey % 5) / (o_orderkey % 3) ELSE 0.0 END AS slots, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 THEN (o_orderkey % 3) * 1000.0 / (o_orderkey % 5) ELSE 0.0 END AS ms FROM orders")
def chain_times(s, d):
    k = F.col("k")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    at = F.when(k % 7 == 0, "1000000000000000").otherwise(F.concat((k * 10000).cast("string"), F.lit(".7")))
    slots, ms = hexabi.slot_rate(k % 5, k % 3)
    return o.select("k", hexabi.iso_utc(hexabi.epoch_to_ts(at)).alias("iso"), slots.alias("slots"), ms.alias("ms"))


@register("result_texts", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 1 THEN 'Revert' END AS reason, o_orderkey % 3 = 1 AS oracle, 'pay' || o_orderkey AS method, 'a\\%b\\_c\\\\' || o_orderkey AS pattern,
CASE o_orderkey % 5 WHEN 0 THEN '/tx/' WHEN 1 THEN '/block/' WHEN 2 THEN '/token/' WHEN 3 THEN '/address/' ELSE '/search?q=' END || o_orderkey AS url, CASE o_orderkey % 3 WHEN 0 THEN 'ERC-20' WHEN 1 THEN 'Token-2022' ELSE 'SPL' END AS kind,
CASE WHEN o_orderkey % 4 < 2 THEN false WHEN o_orderkey % 4 = 2 THEN o_orderkey % 8 <> 2 END AS gated, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 2 END AS n_logs, CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE 's' END AS sender,
CASE WHEN o_orderkey % 6 = 0 THEN 'Uniswap V3' END AS by_code, o_orderkey % 3 = 2 AS complete, CASE o_orderkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'not_verified' WHEN 2 THEN 'not_verified' ELSE 'transient' END AS outcome, 'pair:0xa,0xb' || o_orderkey % 3 AS fingerprint FROM orders""")
def result_texts(s, d):
    k = F.col("k")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    t, none = k.cast("string"), F.lit(None).cast("string")
    failed = F.when(k % 4 == 1, '{"exit_reason":{"code":1,"reason":"Revert"}}').when(k % 4 == 2, '{"exit_reason":{"code":1,"reason":""}}').when(k % 4 == 3, '{"exit_reason":{"code":0,"reason":"x"}}')
    kind = F.when(k % 5 == 0, "tx").when(k % 5 == 1, "block").when(k % 5 == 2, "token").when(k % 5 == 3, "address").otherwise("other")
    module = F.when(k % 4 == 1, hexabi.ZERO_ADDRESS).when(k % 4 > 1, "0xmodule")
    lines = F.when(k % 3 == 1, F.array(F.lit("a"), F.lit("Log truncated"))).when(k % 3 == 2, F.array(F.lit("a")))
    return o.select(
        "k", hexabi.revert_reason(failed).alias("reason"), hexabi.is_oracle(F.when(k % 3 == 1, hexabi.ORACLE_SELECTORS[0]).when(k % 3 == 2, "0x00")).alias("oracle"), hexabi.method_name(F.concat(F.lit("pay"), t, F.lit("(uint256)"))).alias("method"),
        hexabi.escape_like(F.concat(F.lit("a%b_c\\"), t)).alias("pattern"), hexabi.entity_url(kind, t).alias("url"), hexabi.token_kind(F.when(k % 3 != 0, "m"), F.when(k % 3 == 1, "token-2022").when(k % 3 == 2, "spl")).alias("kind"),
        hexabi.gated_verdict(module, F.when(k % 4 == 2, k % 8 == 2)).alias("gated"), hexabi.json_array_len(F.when(k % 3 == 1, "{}").when(k % 3 == 2, "[1,{}]")).alias("n_logs"), hexabi.effective_from(F.when(k % 2 == 0, "d"), F.lit("s")).alias("sender"),
        hexabi.fingerprint_code(F.when(k % 6 == 0, "0x6080128ACB08").otherwise("0x00")).alias("by_code"), hexabi.log_completeness(lines).alias("complete"),
        classify.verify_outcome(F.when(k % 4 == 1, 404).when(k % 4 == 3, 503).otherwise(200), F.when(k % 4 == 0, "n").otherwise(none)).alias("outcome"), reconcile.filter_fingerprint(F.lit("pair"), F.array(F.concat(F.lit("0xB"), (k % 3).cast("string")), F.lit("0xA"), F.lit("0xa"))).alias("fingerprint"),
    )


@register("label_from_probe", "SELECT p_partkey, p_partkey % 4 > 0 AS read, CASE p_partkey % 4 WHEN 1 THEN 'Price Feed' WHEN 3 THEN 'Aave V3' END AS label, CASE p_partkey % 4 WHEN 1 THEN p_name WHEN 3 THEN 'aave ' || p_partkey END AS detail FROM part")
def label_from_probe(s, d):
    n = F.col("p_partkey")
    read, label, detail = hexabi.label_from_probe(F.when(n % 4 == 3, F.concat(F.lit("aave "), n.cast("string"))), F.when(n % 4 == 2, ""), F.when(n % 4 == 2, "0x00"), F.when(n % 4 == 1, F.col("p_name")).when(n % 4 == 2, " "))
    return table(s, d, "part").select("p_partkey", read.alias("read"), label.alias("label"), detail.alias("detail"))


@register("evidence_hash_nested", "SELECT c_custkey, sha256('{\"a\":{\"x\":' || coalesce('\"' || c_mktsegment || '\"', 'null') || ',\"y\":' || c_nationkey || '},\"b\":[{\"p\":1,\"q\":' || c_custkey || '}],\"c\":null}') AS hash FROM customer")
def evidence_hash_nested(s, d):
    own = table(s, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("c"), F.struct(F.col("c_nationkey").alias("y"), F.col("c_mktsegment").alias("x")).alias("a"), F.array(F.struct(F.col("c_custkey").alias("q"), F.lit(1).alias("p"))).alias("b"))
    return own.select("c_custkey", hexabi.evidence_hash_of(own.drop("c_custkey").schema).alias("hash"))


# ---- mirror


@register("ordinal_refresh", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN o_orderkey + 1 WHEN o_orderkey % 3 <> 0 THEN o_orderkey WHEN o_orderkey % 4 <> 0 THEN o_orderkey + 1 END AS ordinal, CASE WHEN o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS leg FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def ordinal_refresh(s, d):
    k = F.col("k")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    return merge.ordinal_refresh(o.where("k % 3 <> 0").select("k", k.alias("ordinal"), F.lit("old").alias("leg")), o.where("k % 2 = 0").select("k", F.when(k % 4 != 0, k + 1).alias("ordinal"), F.lit("new").alias("leg")), ["k"], ["ordinal"])


@register("upsert_if_source", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)) THEN 'new' ELSE 'old' END AS text,
CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)) THEN CASE WHEN o_orderkey % 5 = 0 THEN 'seed' ELSE 'web' END WHEN o_orderkey % 7 = 0 THEN 'raw' ELSE 'web' END AS source FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""")
def upsert_if_source(s, d):
    k = F.col("k")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    old = o.where("k % 3 <> 0").select("k", F.lit("old").alias("text"), F.when(k % 7 == 0, "raw").otherwise("web").alias("source"))
    return merge.upsert_if_source(old, o.where("k % 2 = 0").select("k", F.lit("new").alias("text"), F.when(k % 5 == 0, "seed").otherwise("web").alias("source")), ["k"], "source", "seed", "raw")


@register("selector_placeholders", f"WITH {TXS} SELECT DISTINCT method_id, coalesce(n_name, method_id) AS signature, CASE WHEN n_name IS NULL THEN 'raw' ELSE 'web' END AS source FROM x LEFT JOIN nation ON {H('n_nationkey', 8)} = method_id WHERE method_id IS NOT NULL")
def selector_placeholders(s, d):
    found = table(s, d, "nation").select(hx(F.col("n_nationkey"), 8).alias("method_id"), F.col("n_name").alias("signature"), F.lit("web").alias("source"))
    return merge.selector_placeholders(txs(s, d).where("method_id IS NOT NULL"), found, "method_id", "signature", "source", "raw", F.lit(0)).drop("looked_up_at")


@register("flatten_params", "SELECT o_orderkey, o_custkey AS params_number, o_orderstatus AS params_hash FROM orders")
def flatten_params(s, d):
    return merge.flatten_params(table(s, d, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("number"), F.col("o_orderstatus").alias("hash")).alias("params")))


@register("resolve_sender", f"WITH {TXS} SELECT k, CASE WHEN origination = 'solana_unsigned' THEN from_addr ELSE coalesce(from_addr, from_address) END AS sender FROM x")
def resolve_sender(s, d):
    return txs(s, d).select("k", merge.resolve_sender(F.col("origination"), F.col("from_addr"), F.col("from_address")).alias("sender"))


@register("verified_lag", "SELECT coalesce(t.p, v.p) AS p, tip, verified, tip - verified AS lag FROM (SELECT o_orderpriority AS p, max(o_orderkey) AS tip FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) t FULL JOIN (SELECT o_orderpriority AS p, max(o_orderkey) AS verified FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH' GROUP BY 1) v ON t.p = v.p")
def verified_lag(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderpriority", "p")
    return merge.verified_lag(o.where("p <> '1-URGENT'"), o.where("o_orderstatus = 'F' AND p <> '2-HIGH'"), "p", "o_orderkey")


@register("write_and_read", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def write_and_read(s, d):
    """A table written by partition in each text form and Parquet, and read back with its schema."""
    from slotline.sources.io import read_table, write_table

    own = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = scratch(s)
    write_table(own.where("n_regionkey < 2"), f"{path}/parquet", ["n_regionkey"])
    own.where("n_regionkey = 2").write.json(f"{path}/json")
    own.where("n_regionkey > 2").write.option("header", True).csv(f"{path}/csv")
    kind = own.schema
    return read_table(s, f"{path}/parquet", kind).select(*own.columns).unionByName(read_table(s, f"{path}/json", kind, "json")).unionByName(read_table(s, f"{path}/csv", kind, "csv", header="true"))


# ---- extraction


def results(s, d, keep="true"):
    """tx_hash and a result whose logs are made from the order's key."""
    k = F.col("k")
    x = txs(s, d).where(keep)
    log = lambda address, topics, data: F.struct(address.alias("address"), F.array(*topics).alias("topics"), data.alias("data"))
    wired = log(hx(k % 20, 40), [F.lit(extract.MODULE_SET.upper().replace("0X", "0x")), F.when(k % 3 != 0, extract.TRANSFER_RESTRICTION).otherwise("0x01"), hx(k % 7 + 100, 64)], F.lit("0x"))
    toggled = log(hx(k % 7 + 100, 40), [F.lit(extract.TOGGLED)], F.when(k % 5 == 0, "0x").otherwise(hx(k % 2, 64)))
    created = log(F.lit("0xFA"), [F.lit("0x77"), hx(k, 64), hx(k + 1, 64), hx(k + 2, 64)], F.lit("0x"))
    logs = F.when(k % 4 == 0, F.array(created, wired)).when(k % 4 == 1, F.array(toggled)).when(k % 4 == 2, F.array(wired, toggled))
    receipt = F.to_json(F.struct(hx(k * 3, 8).alias("first_log_index"), (k % 8).alias("tx_index"), hx(F.floor(k / 8), 8).alias("block_number")))
    return x.select("k", "tx_hash", F.to_json(F.struct(logs.alias("logs"))).alias("tx_result"), receipt.alias("receipt_params"))


GATE_ROWS = f"""z AS (SELECT o_orderkey AS k FROM orders), ev AS (SELECT k, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS log_index, 'module_wired' AS event_type, {H('k % 20', 40)} AS token, {H('k % 7 + 100', 40)} AS module, CAST(NULL AS BOOLEAN) AS transfers_allowed FROM z WHERE k % 4 IN (0, 2) AND k % 3 <> 0
UNION ALL SELECT k, CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END, 'transfers_toggled', NULL, {H('k % 7 + 100', 40)}, k % 2 = 1 FROM z WHERE k % 4 IN (1, 2) AND k % 5 <> 0)"""


@register("extract_gate_events", f"WITH {GATE_ROWS} SELECT * FROM ev")
def extract_gate_events(s, d):
    return extract.extract_gate_events(results(s, d), ["k"], "tx_result")


GATE_HISTORY = f"{GATE_ROWS}, gh AS (SELECT k, log_index, event_type, module, transfers_allowed, coalesce(token, last_value(token IGNORE NULLS) OVER (PARTITION BY module ORDER BY k, log_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS token FROM ev)"


@register("gate_history", f"WITH {GATE_HISTORY} SELECT * FROM gh")
def gate_history(s, d):
    return extract.gate_history(extract_gate_events(s, d), ["k", "log_index"])


@register("stale_gates", f"WITH {GATE_HISTORY}, t AS (SELECT {H('c_custkey', 40)} AS token, 'm' AS module, c_custkey % 2 = 0 AS gated FROM customer WHERE c_custkey < 12), m AS (SELECT token, max_by(module, (k, log_index)) FILTER (event_type = 'module_wired') AS module FROM gh WHERE token IS NOT NULL GROUP BY 1) SELECT coalesce(t.token, m.token) AS token, coalesce(m.module, t.module) AS module, CASE WHEN m.token IS NULL THEN t.gated END AS gated FROM t FULL JOIN m ON t.token = m.token")
def stale_gates(s, d):
    c = F.col("c_custkey")
    tokens = table(s, d, "customer").where("c_custkey < 12").select(hx(c, 40).alias("token"), F.lit("m").alias("module"), (c % 2 == 0).alias("gated"))
    return extract.stale_gates(tokens, gate_history(s, d), ["k", "log_index"])


@register("extract_token_created", f"SELECT o_orderkey AS k, 0 AS log_index, '0xfa' AS factory, {H('o_orderkey', 40)} AS creator, {H('o_orderkey + 1', 64)} AS mint, {H('o_orderkey + 2', 40)} AS token FROM orders WHERE o_orderkey % 4 = 0")
def extract_token_created(s, d):
    return extract.extract_token_created(results(s, d), ["k"], "tx_result", "0x77")


def raw_logs(s, d):
    return table(s, d, "lineitem").select(hx(F.col("l_orderkey"), 64).alias("tx_hash"), F.col("l_orderkey"), (F.col("l_linenumber") - 1).alias("log_ordinal"), hx(F.col("l_suppkey") % 5, 40).alias("address"), F.array(hx(F.col("l_partkey") % 3, 64), hx(F.col("l_partkey"), 64)).alias("topics"), F.floor(F.col("l_orderkey") / 8).alias("block_number"))


@register("event_envelope", f"SELECT l_orderkey, l_linenumber - 1 AS log_ordinal, l_orderkey // 8 AS block_number, l_orderkey % 8 AS tx_index, 'b' || l_orderkey // 8 AS block_hash, CASE WHEN l_orderkey % 2 = 0 THEN 's' || l_orderkey END AS signer, l_orderkey * 3 + l_linenumber - 1 AS log_index FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) AND l_orderkey // 8 % 9 <> 0")
def event_envelope(s, d):
    k = F.col("k")
    signers = txs(s, d).select("tx_hash", F.when(k % 2 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("signer"))
    blocks = txs(s, d).select(F.floor(k / 8).alias("block_number")).distinct().where("block_number % 9 <> 0").withColumn("block_hash", F.concat(F.lit("b"), F.col("block_number").cast("string")))
    return extract.event_envelope(raw_logs(s, d).drop("block_number"), signers, results(s, d, "k % 5 <> 0"), blocks).select("l_orderkey", "log_ordinal", "block_number", "tx_index", "block_hash", "signer", "log_index")


@register("logs_of", f"SELECT {H('l_orderkey', 64)} AS tx_hash, l_orderkey // 8 AS block_number, l_orderkey % 8 AS tx_index, l_orderkey * 3 + l_linenumber - 1 AS log_index, CASE WHEN l_orderkey % 4 = 1 AND l_linenumber = 1 OR l_orderkey % 4 = 2 AND l_linenumber = 2 THEN CASE WHEN l_orderkey % 5 = 0 THEN '0x' ELSE {H('l_orderkey % 2', 64)} END WHEN l_orderkey % 4 IN (0, 2) AND l_linenumber <= 2 THEN '0x' END AS data FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 5 = 3 AND l_partkey % 3 = 1")
def logs_of(s, d):
    return extract.logs_of(raw_logs(s, d).drop("block_number"), results(s, d), "0x" + "0" * 39 + "3", "0x" + "0" * 63 + "1").drop("topics")


@register("filter_logs", "SELECT l_orderkey, l_linenumber - 1 AS log_ordinal FROM lineitem WHERE l_orderkey // 8 BETWEEN 50 AND 5000 AND l_suppkey % 5 IN (1, 2) AND l_partkey % 3 IN (0, 2)")
def filter_logs(s, d):
    word = lambda n, w: "0x" + f"{n:x}".rjust(w, "0")
    return extract.filter_logs(raw_logs(s, d), 50, 5000, [word(1, 40), word(2, 40).upper().replace("0X", "0x")], [[word(0, 64), word(2, 64)], None]).select("l_orderkey", "log_ordinal")


@register("decode_registry", f"""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS q, l_orderkey % 6 AS c, l_returnflag || '-' || l_linestatus AS t FROM lineitem)
SELECT o, n, CASE c WHEN 0 THEN 'Transfer' WHEN 1 THEN 'WhitelistStatusChanged' WHEN 2 THEN 'Withdraw' WHEN 3 THEN 'StorefrontConfigSet' WHEN 4 THEN CASE WHEN n > 1 THEN 'TokenNameUpdated' END ELSE NULL END AS event_name,
CASE c WHEN 1 THEN CASE WHEN p % 3 = 2 THEN 'bad_bool' END WHEN 2 THEN CASE WHEN n = 1 THEN 'trailing_data' END WHEN 3 THEN CASE WHEN n = 2 THEN 'malformed_dynamic' WHEN n = 3 THEN 'bad_utf8' END WHEN 4 THEN CASE WHEN n = 1 THEN 'missing_topic0' WHEN n = 2 THEN 'bad_hex' WHEN n = 3 THEN 'short_data' END WHEN 5 THEN 'unknown_topic' END AS reason,
CASE c WHEN 0 THEN {H('p', 40)} || ' ' || {H('q', 40)} || ' ' || {H('o', 64)} WHEN 1 THEN CASE WHEN p % 3 < 2 THEN {H('q', 40)} || ' ' || (p % 3 = 1) END WHEN 2 THEN CASE WHEN n > 1 THEN {H('q', 40)} || ' ' || {H('p', 40)} || ' ' || {H('n', 64)} END WHEN 3 THEN CASE WHEN n NOT IN (2, 3) THEN t END WHEN 4 THEN CASE WHEN n > 3 THEN t || ' ' || t END END AS shown FROM l""")
def decode_registry(s, d):
    """Logs of six sorts through the whole registry: words, bools, unindexed addresses, one and two texts, unknown ones."""
    table_ = {(kind, name): topic for kind, topic, name, *_ in registry.descriptors()}
    o, n, p, q = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    mode = F.concat_ws("-", "l_returnflag", "l_linestatus")
    c, w = o % 6, lambda x: F.substring(hx(x, 64), 3, 64)
    body = F.lower(F.hex(F.encode(mode, "UTF-8")))
    text = lambda size=F.octet_length(mode), b=body: F.concat(w(size.cast("bigint")), F.rpad(b, 64, "0"))
    of = lambda *key: F.lit(table_[key])
    kinds = ["ARC_TOKEN", "AXIS1_MODULE", "MORPHO", "STOREFRONT", "ARC_TOKEN", "ROUTER"]
    topics = F.when(c == 0, F.array(of("ARC_TOKEN", "Transfer"), hx(p, 64), hx(q, 64))).when(c == 1, F.array(of("AXIS1_MODULE", "WhitelistStatusChanged"), hx(q, 64))).when(c == 2, F.array(of("MORPHO", "Withdraw"), hx(o, 64), hx(p, 64), hx(p + 1, 64))).when(c == 3, F.array(of("STOREFRONT", "StorefrontConfigSet"), hx(p, 64))).when(c == 4, F.when(n == 1, F.array().cast("array<string>")).otherwise(F.array(of("ARC_TOKEN", "TokenNameUpdated")))).otherwise(F.array(of("ARC_TOKEN", "Transfer"), hx(p, 64), hx(q, 64)))
    one = F.when(n == 2, F.concat(w(F.lit(32)), text(F.lit(500)))).when(n == 3, F.concat(w(F.lit(32)), text(F.lit(2), F.lit("c328")))).otherwise(F.concat(w(F.lit(32)), text()))
    two = F.when(n == 2, F.concat(F.lit("zz"), F.substring(F.concat(w(F.lit(64)), w(F.lit(128)), text(), text()), 3, 1000))).when(n == 3, w(F.lit(64))).otherwise(F.concat(w(F.lit(64)), w(F.lit(128)), text(), text()))
    data = F.when(c == 0, w(o)).when(c == 1, w(p % 3)).when(c == 2, F.concat(w(q), w(n.cast("bigint")), w(p), F.when(n == 1, w(p)).otherwise(""))).when(c == 3, one).when(c == 4, two).otherwise(w(o))
    logs = table(s, d, "lineitem").select(o.alias("o"), n.alias("n"), F.element_at(F.array(*[F.lit(x) for x in kinds]), (c + 1).cast("int")).alias("source_kind"), topics.alias("topics"), F.concat(F.lit("0x"), data).alias("data"))
    got = extract.decode_events(logs, registry.registry(s))
    arg = lambda *names: F.concat_ws(" ", *[F.try_element_at("decoded", F.lit(x)) for x in names])
    shown = F.when(F.col("event_name") == "Transfer", arg("from", "to", "value")).when(F.col("event_name") == "WhitelistStatusChanged", arg("account", "isWhitelisted")).when(F.col("event_name") == "Withdraw", arg("caller", "onBehalf", "assets")).when(F.col("event_name") == "StorefrontConfigSet", arg("domain")).otherwise(arg("oldName", "newName"))
    return got.select("o", "n", "event_name", "reason", F.when(F.col("decoded").isNotNull(), shown).alias("shown"))


LINES = "l AS (SELECT l_orderkey AS sig, l_linenumber * 1000000 + l_partkey AS n, min(l_suppkey) % 3 AS p, l_partkey % 4 AS q FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey)"


def program_log(q, p):
    """Six log lines: a top program and a deeper call of the keys' own numbers."""
    q, p = q.cast("string"), p.cast("string")
    return F.array(F.concat(F.lit("Program T"), p, F.lit(" invoke [1]")), F.concat(F.lit("Program D"), q, F.lit(" invoke [2]")), F.concat(F.lit("Program log: Instruction: I"), q), F.concat(F.lit("Program D"), q, F.lit(" success")), F.lit("Program log: Instruction: Late"), F.concat(F.lit("Program T"), p, F.lit(" success")))


def program_lines(s, d):
    """The log of each place and part, a row a line."""
    places = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("p"))
    deep = program_log(F.col("l_partkey") % 4, F.col("p") % 3)
    return places.select(F.col("l_orderkey").alias("sig"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("n"), F.posexplode(deep).alias("i", "line")).select("sig", (F.col("n") * 10 + F.col("i")).alias("line_no"), "line")


def program_logs(s, d):
    """The same log lines as one array an order, in the order of its places."""
    own = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    places = own.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg((F.min("l_suppkey") % 3).alias("p"))
    place = F.struct((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("n"), (F.col("l_partkey") % 4).alias("q"), "p")
    held = places.groupBy(F.col("l_orderkey").alias("sig")).agg(F.array_sort(F.collect_list(place)).alias("places"))
    return held.select("sig", F.flatten(F.transform("places", lambda x: program_log(x["q"], x["p"]))).alias("lines"))


@register("parse_invokes", f"WITH {LINES} SELECT sig, n * 10 AS line_no, 'T' || p AS program, 1 AS depth FROM l UNION ALL SELECT sig, n * 10 + 1, 'D' || q, 2 FROM l")
def parse_invokes(s, d):
    return extract.parse_invokes(program_lines(s, d), ["sig"])


@register("top_level_programs", f"WITH {LINES} SELECT sig, list_sort(list(DISTINCT 'T' || p)) AS programs FROM l GROUP BY 1")
def top_level_programs(s, d):
    return extract.top_level_programs(parse_invokes(s, d), ["sig"])


@register("cpi_target", f"WITH {LINES} SELECT sig, 'D' || min_by(q, n) AS program, 'I' || min_by(q, n) AS instruction FROM l WHERE q NOT IN (0, 1) GROUP BY 1")
def cpi_target(s, d):
    return extract.cpi_targets(program_logs(s, d), ["D0", "D1"]).select("sig", "program", "instruction")


HOOKS = "v AS (SELECT o_orderkey AS k, o_orderkey % 5 AS c FROM orders)"


def hook_logs(s, d):
    """Router log of each order, an array a transaction: passes with and without an EVM target, a revert, a failure that ends the run, none."""
    k = F.col("k")
    t = k.cast("string")
    head = F.concat(F.lit("Program log: Meta-Hook Router: executing "), (F.when(k % 5 == 4, 3).otherwise(2)).cast("string"), F.lit(" hooks for mint M"), (k % 9).cast("string"), F.lit(" ,"))
    evm = [F.lit("Program E invoke [3]"), F.concat(F.lit("Program log: Call: from 0x1, to 0xAB"), t), F.concat(F.lit("Program E consumed "), t, F.lit(" of 200000 compute units"))]
    first = F.array(*evm, F.lit("Program log: Hook[0] slot=1 result=pass"))
    native = F.array(F.concat(F.lit("Program N"), t, F.lit(" invoke [3]")), F.lit("Program log: Hook[1] slot=2 result=reject  kyc failed"))
    fails = F.array(*evm, F.lit("Program log: EVM callback reverted: Revert(X)"), F.lit("Program E failed: custom program error: 0x0"), F.lit("Program E failed: again"), F.lit("Program log: Hook[1] slot=2"))
    tail = F.array(F.lit("Program R success"), F.lit("Program log: Hook[9] slot=9 result=pass"))
    none = F.array().cast("array<string>")
    c = k % 5
    lines = F.concat(F.array(F.lit("Program log: Hook[7] result=pass"), F.lit("Program R1 invoke [1]"), head), first, F.when(c == 1, native).when(c == 2, fails).when(c == 3, F.array(F.lit("Program Q invoke [3]"), F.lit("Program Q failed: custom program error: 0x1"))).otherwise(none), tail)
    # the keys are dealt out, as one file of one row group would be read by one task
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k")).repartition("k").select("k", lines.alias("lines"))


EXECUTIONS = f"{HOOKS}, x AS (SELECT k, 1 AS idx, '0xab' || k AS hook_address, 'evm_custom' AS hook_kind, 'pass' AS result, CAST(NULL AS VARCHAR) AS reason, k AS gas_used FROM v UNION ALL SELECT k, 2, 'N' || k, 'native', 'reject', 'kyc failed', NULL FROM v WHERE c = 1 UNION ALL SELECT k, 2, '0xab' || k, 'evm_custom', 'reject', 'Revert(X)', k FROM v WHERE c = 2 UNION ALL SELECT k, 2, 'Q', 'native', 'reject', 'custom program error: 0x1', NULL FROM v WHERE c = 3)"


@register("hook_executions", f"WITH {EXECUTIONS} SELECT * FROM x")
def hook_executions(s, d):
    return extract.hook_executions(hook_logs(s, d), ["k"], "R")


@register("hook_mismatch", f"WITH {HOOKS} SELECT k, CASE WHEN c = 4 THEN 3 ELSE 2 END AS stated, 1 AS parsed FROM v WHERE c IN (0, 4)")
def hook_mismatch(s, d):
    return extract.hook_mismatch(hook_logs(s, d), ["k"], "R")


@register("hook_invocations", f"WITH {HOOKS} SELECT k, 'M' || k % 9 AS mint, CASE WHEN c = 4 THEN 3 ELSE 2 END AS hook_count, CASE k % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'reject' ELSE 'error' END AS outcome, CASE k % 4 WHEN 0 THEN 'p' || k WHEN 1 THEN 'p' || k END AS fee_payer FROM v")
def hook_invocations(s, d):
    k = F.col("k")
    text = F.concat(F.lit("p"), k.cast("string"))
    keys = F.when(k % 4 == 0, F.concat(F.lit('["'), text, F.lit('"]'))).when(k % 4 == 1, F.concat(F.lit('[{"pubkey":"'), text, F.lit('"}]'))).when(k % 4 == 2, "[]")
    error = F.when(k % 3 == 0, "null").when(k % 3 == 1, '{"InstructionError":[0,{"Custom":1}]}').otherwise('"BlockhashNotFound"')
    return extract.hook_invocations(hook_logs(s, d).withColumns({"error": error, "account_keys": keys})).select("k", "mint", "hook_count", "outcome", "fee_payer")


@register("decode_call_target", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 < 4 THEN CASE WHEN o_orderkey % 6 = 0 THEN '11111111111111111111111111111111' ELSE CASE WHEN o_orderkey % 6 = 1 THEN 'TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA' WHEN o_orderkey % 6 = 2 THEN 'Eo7WjKq67rjJQSZxS6z3YkapzY3eMj6Xy8X5EQVn5UaB' ELSE 'Eo7WjKq67rjJQSZxS6z3YkapzY3eMj6Xy8X5EQVn5UaB' END END END AS program,
CASE WHEN o_orderkey % 6 = 0 THEN 'System' WHEN o_orderkey % 6 = 1 THEN 'SPL-Token' WHEN o_orderkey % 6 < 4 THEN 'Meteora DAMM v1' END AS label,
CASE o_orderkey % 6 WHEN 0 THEN 'anchor:' || lpad(lower(to_hex(o_orderkey)), 16, '0') WHEN 1 THEN CASE o_orderkey % 4 WHEN 0 THEN 'InitializeMint' WHEN 1 THEN 'InitializeAccount' WHEN 2 THEN 'InitializeMultisig' ELSE 'Transfer' END WHEN 2 THEN 'Swap' WHEN 3 THEN 'anchor:' || lpad(lower(to_hex(o_orderkey)), 16, '0') END AS instruction FROM orders""")
def decode_call_target(s, d):
    """Calls to the precompile: three programs, a known and an unknown instruction; then a length beyond the data, another target."""
    k = F.col("k")
    bytes_of = {}
    for name in ("TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", "Eo7WjKq67rjJQSZxS6z3YkapzY3eMj6Xy8X5EQVn5UaB"):
        n = 0
        for c in name:
            n = n * 58 + hexabi.BASE58.index(c)
        bytes_of[name] = f"{n:064x}"
    token, pool = bytes_of.values()
    c, w = k % 6, lambda x: F.substring(hx(x, 64), 3, 64)
    program = F.when(c == 0, "0" * 64).when(c == 1, token).otherwise(pool)
    data = F.when(c == 1, F.lpad(F.lower(F.hex(k % 4)), 2, "0")).when(c == 2, extract.discriminator("Swap")).otherwise(F.lpad(F.lower(F.hex(k)), 16, "0"))
    size = F.when(c == 4, F.lit(1000)).otherwise(F.length(data) / 2).cast("bigint")
    call = F.concat(F.lit("0x7480CB86"), program, w(F.lit(0)), w(F.lit(96)), w(size), data)
    to = F.when(c == 5, "0x00").otherwise(hexabi.CPI.upper().replace("0X", "0x"))
    own = table(s, d, "orders").select(F.col("o_orderkey").alias("k")).select("k", to.alias("to"), call.alias("input"))
    return extract.decode_call_target(own, "to", "input").drop("to", "input")


# ---- classification

SIGS = f"""{TXS}, sg AS (SELECT l_orderkey AS k, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS sig, min(l_suppkey) % 4 AS p, l_partkey % 6 AS q FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey), rd AS (SELECT * FROM sg WHERE q <> 5),
gr AS (SELECT sg.k, list_sort(list(DISTINCT sg.sig)) AS sigs, list_sort(list(DISTINCT 'T' || p) FILTER (p > 1)) AS own, count(*) FILTER (q = 5) AS unread, min_by(q, sig) FILTER (q < 2) AS tq FROM sg GROUP BY 1)"""


@register("correlations", f"""WITH {SIGS}, r AS (SELECT x.tx_hash, CASE WHEN origination <> 'solana_unsigned' AND len(coalesce(own, [])) > 0 THEN 'Romulus' ELSE 'Rhea' END AS tx_type, CASE WHEN origination <> 'solana_unsigned' THEN coalesce(own, []) ELSE [] END AS flipping, x.slot_number AS block_number, 'D' || tq AS cpi_program, sigs FROM x JOIN gr USING (k) WHERE unread = 0)
SELECT tx_hash, tx_type, flipping, block_number, cpi_program, CASE WHEN tx_type = 'Romulus' THEN len(sigs) ELSE 0 END AS n_legs FROM r WHERE tx_type <> 'Rhea' OR cpi_program IS NOT NULL""")
def correlations(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("p"))
    li = li.select(F.lit(1).cast("bigint").alias("chain_id"), hx(F.col("l_orderkey"), 64).alias("tx_hash"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("signature"), (F.col("p") % 4).alias("p"), (F.col("l_partkey") % 6).alias("q"))
    programs = li.where("q <> 5").select("signature", F.array(F.lit("infra"), F.concat(F.lit("T"), F.col("p").cast("string"))).alias("programs"))
    targets = li.where("q < 2").select("signature", F.concat(F.lit("D"), F.col("q").cast("string")).alias("program"), F.lit("Swap").alias("instruction"))
    got = classify.correlations(txs(s, d).withColumn("block_number", F.col("slot_number")), li.select("chain_id", "tx_hash", "signature"), programs, targets, ["infra", "T0", "T1"], "main")
    return got.select("tx_hash", "tx_type", "flipping", "block_number", "cpi_program", F.size("solana_legs").alias("n_legs"))


@register("tx_type", "SELECT l_orderkey, CASE WHEN l_orderkey % 6 <> 0 AND own > 0 THEN 'Romulus' ELSE 'Rhea' END AS tx_type, CASE WHEN l_orderkey % 6 <> 0 THEN own ELSE 0 END AS flipping FROM (SELECT l_orderkey, count(DISTINCT l_suppkey % 4) FILTER (l_suppkey % 4 > 1) AS own FROM lineitem GROUP BY 1)")
def tx_type(s, d):
    top = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 4).cast("string")).alias("top"))
    kind, own = classify.tx_type(F.col("top"), F.array(F.lit("0"), F.lit("1")), F.when(F.col("l_orderkey") % 6 == 0, "solana_unsigned").otherwise("ecdsa"))
    return top.select("l_orderkey", kind.alias("tx_type"), F.size(own).alias("flipping"))


# ---- joins


@register("tx_feed", f"WITH {TXS} SELECT x.tx_hash, slot_number * 2 + slot_block_idx AS number, coalesce(n_name || '(uint256)', method_id, '0x') AS method, CASE WHEN k % 7 = 0 THEN 'Romulus' ELSE 'Rhea' END AS tx_type, coalesce(from_addr, from_address) AS sender, CASE WHEN k % 2 = 0 THEN 'c' END AS class, CASE WHEN k % 5 <> 2 THEN 'r' END AS result FROM x LEFT JOIN nation ON {H('n_nationkey', 8)} = method_id WHERE slot_number % 11 <> 5 AND k % 13 <> 0")
def tx_feed(s, d):
    x = txs(s, d)
    place = ["chain_id", "slot_number", "slot_block_idx"]
    blocks = x.where("slot_number % 11 <> 5").select(*place).distinct().withColumn("number", F.col("slot_number") * 2 + F.col("slot_block_idx"))
    side = lambda cond, name, value: x.where(cond).select("chain_id", "tx_hash", F.lit(value).alias(name))
    methods = table(s, d, "nation").select(hx(F.col("n_nationkey"), 8).alias("method_id"), F.concat("n_name", F.lit("(uint256)")).alias("signature"))
    got = joins.tx_feed(x.select(*place, "tx_hash", "tx_idx"), x.where("k % 13 <> 0").select("chain_id", "tx_hash", "from_addr", "from_address", "method_id"), side("k % 5 <> 2", "result", "r"), blocks, methods, side("k % 7 = 0", "tx_type", "Romulus"), side("k % 2 = 0", "class", "c"))
    return got.select("tx_hash", "number", "method", "tx_type", "sender", "class", "result")


def executions(s, d):
    return table(s, d, "lineitem").where("l_returnflag = 'R'").select(hx(F.col("l_orderkey"), 64).alias("tx_hash"), F.col("l_linenumber").alias("idx"), F.col("l_suppkey").alias("hook"), F.col("l_linestatus").alias("result"))


def hook_names(s, d):
    own = table(s, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("hook"), F.col("s_name").alias("name"))
    return own.unionByName(own.withColumn("name", F.concat("name", F.lit("z"))))


HOOKED = "hk AS (SELECT l_orderkey, list_sort(list(l_linenumber || ':' || coalesce(s_name, '-') || ':' || l_linestatus)) AS hooks FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 4 <> 0 WHERE l_returnflag = 'R' GROUP BY 1)"
def shown_hooks():
    return F.array_sort(F.transform("hooks", lambda h: F.concat_ws(":", h["idx"].cast("string"), F.coalesce(h["hook_name"], F.lit("-")), h["result"])))


@register("attach_hooks_named", f"WITH {HOOKED} SELECT {H('o_orderkey', 64)} AS tx_hash, coalesce(hooks, []) AS hooks FROM orders LEFT JOIN hk ON l_orderkey = o_orderkey")
def attach_hooks_named(s, d):
    return joins.attach_hooks(txs(s, d).select("tx_hash"), executions(s, d), hook_names(s, d)).select("tx_hash", shown_hooks().alias("hooks"))


@register("tx_detail", f"WITH {HOOKED}, t AS (SELECT l_orderkey, min(l_linenumber || '-' || l_partkey) AS f, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY 1) SELECT {H('o_orderkey', 64)} AS tx_hash, f AS first_signature, coalesce(n, 0) AS n_transfers, coalesce(hooks, []) AS hooks FROM orders LEFT JOIN t ON t.l_orderkey = o_orderkey LEFT JOIN hk ON hk.l_orderkey = o_orderkey")
def tx_detail(s, d):
    li = table(s, d, "lineitem").withColumns({"chain_id": F.lit(1).cast("bigint"), "tx_hash": hx(F.col("l_orderkey"), 64)})
    got = joins.tx_detail(txs(s, d).select("chain_id", "tx_hash"), li.select("chain_id", "tx_hash", F.concat_ws("-", "l_linenumber", "l_partkey").alias("signature")), li.where("l_returnflag = 'A'").select("chain_id", "tx_hash", F.col("l_linenumber").alias("log_index"), F.col("l_suppkey").alias("token")), executions(s, d), hook_names(s, d))
    return got.select("tx_hash", "first_signature", F.size("transfers").cast("bigint").alias("n_transfers"), shown_hooks().alias("hooks"))


@register("anti_no_trace", f"SELECT {H('o_orderkey', 64)} AS tx_hash FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_no_trace(s, d):
    return joins.anti_no_trace(txs(s, d).select("chain_id", "tx_hash"), executions(s, d).withColumn("chain_id", F.lit(1).cast("bigint"))).select("tx_hash")


@register("synthetic_owner", f"WITH {TXS} SELECT coalesce(from_addr, from_address) AS address, min(solana_signer) AS owner FROM x WHERE origination <> 'ecdsa' AND solana_signer IS NOT NULL GROUP BY 1")
def synthetic_owner(s, d):
    return joins.synthetic_owner(txs(s, d))


@register("creators", f"WITH {TXS} SELECT {H('k % 101', 40)} AS address, min_by(coalesce(CASE WHEN k % 2 = 0 THEN {H('o_custkey + 5', 40)} END, from_addr, from_address), k) AS creator FROM x WHERE to_addr IS NULL AND input_len > 0 AND k % 9 <> 4 GROUP BY 1")
def creators(s, d):
    k = F.col("k")
    receipts = txs(s, d).where("k % 9 <> 4").join(table(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), "k").select("tx_hash", hx(k % 101, 40).alias("contract_address"), F.when(k % 2 == 0, hx(F.col("o_custkey") + 5, 40)).alias("receipt_from"), k.alias("block_number"))
    return joins.creators(txs(s, d), receipts)


SCOPE = f"""ev AS (SELECT event_id, {H('user_id % 50', 40)} AS address, {SEC} // 3600 % 1000 AS block, {H('event_id % 7', 40)} AS sender, {H('event_id % 11', 40)} AS receiver, CASE WHEN event_id % 4 <> 0 THEN {H('event_id % 5', 40)} END AS id FROM events),
sp AS (SELECT c_custkey % 40 AS asset_id, {H('c_custkey % 50', 40)} AS address, c_custkey % 900 AS from_block, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 900 + 100 END AS to_block, c_custkey % 4 AS f, [{H('c_custkey % 7', 40)}, {H('c_custkey % 5', 40)}] AS vals FROM customer),
ok AS (SELECT asset_id, event_id, ev.block, from_block, to_block FROM ev JOIN sp USING (address) WHERE CASE f WHEN 0 THEN true WHEN 1 THEN list_contains(vals, sender) WHEN 2 THEN list_contains(vals, sender) OR list_contains(vals, receiver) ELSE id IS NULL OR list_contains(vals, id) END)"""


def scope(s, d):
    e = F.col("event_id")
    ev = table(s, d, "events").select("event_id", hx(F.col("user_id") % 50, 40).alias("address"), (F.floor(F.unix_timestamp("ts") / 3600) % 1000).alias("block"), hx(e % 7, 40).alias("sender"), hx(e % 11, 40).alias("receiver"), F.when(e % 4 != 0, hx(e % 5, 40)).alias("id"))
    c = F.col("c_custkey")
    kind = F.when(c % 4 == 0, "none").when(c % 4 == 1, "from").when(c % 4 == 2, "touch").otherwise("ids")
    sp = table(s, d, "customer").select((c % 40).alias("asset_id"), hx(c % 50, 40).alias("address"), (c % 900).alias("from_block"), F.when(c % 3 != 0, c % 900 + 100).alias("to_block"), kind.alias("filter_kind"), F.array(hx(c % 7, 40), hx(c % 5, 40)).alias("filter_values"))
    return ev, sp


@register("asset_events", f"WITH {SCOPE} SELECT DISTINCT asset_id, event_id FROM ok WHERE block >= from_block AND (to_block IS NULL OR block < to_block)")
def asset_events(s, d):
    return joins.asset_events(*scope(s, d), width=50).select("asset_id", "event_id")


@register("filter_union", f"WITH {SCOPE} SELECT DISTINCT event_id FROM ok")
def filter_union(s, d):
    return joins.filter_union(*scope(s, d)).select("event_id")


ROLES = "ro AS (SELECT CAST(c_custkey % 20 AS VARCHAR) AS source, CAST(c_custkey % 30 AS VARCHAR) AS account, c_nationkey AS role, c_custkey % 900 AS from_block, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 900 + 50 END AS to_block FROM customer)"


def roles(s, d):
    c = F.col("c_custkey")
    return table(s, d, "customer").select((c % 20).cast("string").alias("source"), (c % 30).cast("string").alias("account"), F.col("c_nationkey").alias("role"), (c % 900).alias("from_block"), F.when(c % 4 != 0, c % 900 + 50).alias("to_block"))


@register("role_open_at", f"WITH {ROLES} SELECT o_orderkey, role, from_block FROM orders JOIN ro ON source = CAST(o_custkey % 20 AS VARCHAR) AND account = CAST(o_orderkey % 30 AS VARCHAR) AND o_orderkey % 1000 >= from_block AND (to_block IS NULL OR o_orderkey % 1000 <= to_block)")
def role_open_at(s, d):
    points = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).cast("string").alias("source"), (F.col("o_orderkey") % 30).cast("string").alias("account"), (F.col("o_orderkey") % 1000).alias("block"))
    return joins.role_open_at(points, roles(s, d), bits=6).select("o_orderkey", "role", "from_block")


@register("signer_attribution", f"""WITH {ROLES}, ch AS (SELECT o_orderkey, o_custkey % 20 AS asset, o_orderkey % 1000 AS block, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 30 AS VARCHAR) END AS signer FROM orders),
held AS (SELECT DISTINCT o_orderkey FROM ch JOIN ro ON account = signer AND source IN (CAST(asset AS VARCHAR), CAST((asset + 1) % 20 AS VARCHAR)) AND block >= from_block AND (to_block IS NULL OR block <= to_block))
SELECT o_orderkey, CASE WHEN signer IS NULL THEN 'UNKNOWN' WHEN signer = '7' THEN 'MULTISIG' WHEN h.o_orderkey IS NOT NULL THEN 'ISSUER_KEY' ELSE 'UNKNOWN' END AS signed_by FROM ch LEFT JOIN held h USING (o_orderkey)""")
def signer_attribution(s, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    changes = table(s, d, "orders").select("o_orderkey", (c % 20).alias("asset_id"), (o % 1000).alias("block"), F.when(o % 5 != 0, (o % 30).cast("string")).alias("signer"), F.when(o % 2 == 0, "x").alias("before"))
    a = F.col("asset_id")
    sources = changes.select("asset_id").distinct().select("asset_id", F.explode(F.array(a, (a + 1) % 20).cast("array<string>")).alias("source"))
    return joins.signer_attribution(changes, sources, roles(s, d), "7", ["o_orderkey"]).select("o_orderkey", "signed_by")


@register("hook_registry_observed", "SELECT DISTINCT l_suppkey AS hook FROM lineitem WHERE l_suppkey % 2 <> 0")
def hook_registry_observed(s, d):
    return joins.registry_observed(table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("hook")), table(s, d, "lineitem").select(F.col("l_suppkey").alias("hook")), ["hook"])


@register("pair_closure", """WITH RECURSIVE ed AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem), r AS (SELECT CAST(1 AS BIGINT) AS address UNION SELECT b FROM ed JOIN r ON a = address WHERE b % 3 <> 0) SELECT address FROM r""")
def pair_closure(s, d):
    edges = table(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).distinct()
    return joins.pair_closure(edges, s.range(100).where("id % 3 <> 0").select(F.col("id").alias("address")), s.range(1, 2).select(F.col("id").alias("address")), 100)


# ---- aggregates


@register("circulating_supply", "SELECT n_nationkey AS token, CASE WHEN n_regionkey % 2 = 0 THEN CAST(s AS VARCHAR) END AS supply FROM nation LEFT JOIN (SELECT c_nationkey, sum(CAST(round(c_acctbal * 100) AS HUGEINT)) AS s FROM customer WHERE round(c_acctbal * 100) > 0 GROUP BY 1) ON c_nationkey = n_nationkey")
def circulating_supply(s, d):
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    balances = table(s, d, "customer").select(F.col("c_nationkey").alias("token"), F.col("c_custkey").alias("holder"), u256.normalise(u256.from_long(cents)).alias("balance"))
    tokens = table(s, d, "nation").select(F.col("n_nationkey").alias("token"), "n_regionkey")
    return aggs.circulating_supply(balances, tokens, F.col("n_regionkey") % 2 == 0).select("token", u256.to_string(F.col("supply")).alias("supply"))


@register("slot_range_for_blocks", "SELECT min(o_orderkey // 8) AS from_slot, max(o_orderkey // 8) AS to_slot FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def slot_range_for_blocks(s, d):
    return aggs.slot_range_for_blocks(txs(s, d), 100, 900, "k", "slot_number")


@register("finalized_tip", "SELECT max(o_orderkey) AS tip FROM orders WHERE o_orderstatus = 'P'")
def finalized_tip(s, d):
    return aggs.finalized_tip(table(s, d, "orders").select(F.col("o_orderkey").alias("slot"), F.when(F.col("o_orderstatus") == "P", "Finalized").otherwise("Confirmed").alias("status")))


# ---- sequences


@register("member_intervals_zero", f"""WITH m AS (SELECT user_id, {SEC} AS sec, event_id, event_type = 'signup' AS f FROM events WHERE event_type IN ('signup', 'error') AND user_id % 10 <> 0),
l AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY sec, event_id), false) AS was FROM m), t AS (SELECT * FROM l WHERE f <> was),
n AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS nxt FROM t) SELECT user_id, event_id AS from_id, nxt AS to_id FROM n WHERE f""")
def member_intervals_zero(s, d):
    own = events(s, d).where(F.col("event_type").isin("signup", "error"))
    return seq.member_intervals(own, ["user_id"], ["sec", "event_id"], F.col("event_type") == "signup", F.col("user_id") % 10 == 0).select("user_id", F.col("from_pos.event_id").alias("from_id"), F.col("to_pos.event_id").alias("to_id"))


@register("register_epochs", f"""WITH m AS (SELECT user_id, {SEC} AS sec, event_id, CASE WHEN event_type <> 'error' AND event_id % 5 > 1 AND event_id % 7 <> 0 THEN {H('event_id % 7', 40)} END AS m FROM events WHERE event_type IN ('signup', 'error', 'purchase') AND event_id % 4 <> 0 AND (event_type <> 'signup' OR (event_id % 3 <> 0 AND event_id % 5 <> 0))),
n AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS to_id FROM m) SELECT user_id, m AS module, event_id AS from_id, to_id FROM n WHERE m IS NOT NULL""")
def register_epochs(s, d):
    e = F.col("event_id")
    kind = F.col("event_type")
    own = events(s, d).where(kind.isin("signup", "error", "purchase")).select("user_id", "sec", "event_id", F.when(kind == "signup", "ModuleTypeRegistered").when(kind == "error", "ModuleTypeRemoved").otherwise("GlobalImplementationUpdated").alias("event_name"), F.when(e % 4 != 0, "t").otherwise("u").alias("type_id"), (e % 3 != 0).alias("is_global"), F.when(e % 5 == 1, hexabi.ZERO_ADDRESS).when(e % 5 > 1, hx(e % 7, 40)).alias("module"))
    return seq.register_epochs(own, ["user_id"], ["sec", "event_id"], "t").select("user_id", "module", F.col("from_pos.event_id").alias("from_id"), F.col("to_pos.event_id").alias("to_id"))


@register("screening_gaps", f"""WITH RECURSIVE {stack_sql('t', "SELECT user_id AS g, event_id, event_type = 'view' AS o FROM events WHERE event_type IN ('view', 'purchase')")},
m AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'm' END AS m FROM events WHERE event_type IN ('signup', 'error')), n AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS to_id FROM m)
SELECT t.g AS user_id, t.event_id AS close_id FROM t JOIN n ON n.user_id = t.g AND n.m IS NOT NULL AND t.event_id >= n.event_id AND (n.to_id IS NULL OR t.event_id < n.to_id) WHERE NOT t.o AND t.m IS NULL""")
def screening_gaps(s, d):
    ev = events(s, d)
    pairs = seq.lifo_pair(ev, ["user_id"], ["event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase", "event_id")
    spells = seq.epoch_intervals(ev.where(F.col("event_type").isin("signup", "error")), ["user_id"], ["event_id"], F.when(F.col("event_type") == "signup", "m"))
    return seq.screening_gaps(pairs, spells, ["user_id"], "close_id").select("user_id", "close_id")


@register("yield_credits", f"""WITH y AS (SELECT user_id, event_id, event_type, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY {SEC}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events WHERE event_type IN ('view', 'purchase'))
SELECT user_id, CAST(run AS BIGINT) AS run, event_id, event_id % 9 AS holder, event_id % 100 AS share FROM y WHERE event_type = 'view' AND event_id % 9 <> 4""")
def yield_credits(s, d):
    e = F.col("event_id")
    own = events(s, d).where(F.col("event_type").isin("view", "purchase"))
    return seq.yield_credits(own, ["user_id"], ["sec", "event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase", F.when(e % 9 != 4, e % 9), e % 100).drop("sec")


CODE = f"""b AS (SELECT o_orderkey AS k, {H('o_custkey % 20', 40)} AS source, o_orderkey % 3 AS sk, o_orderkey % 8 AS c, CASE WHEN o_orderkey % 11 <> 0 THEN {H('o_orderkey % 13', 40)} END AS a, {H('o_orderkey % 6', 40)} AS tok, CASE WHEN o_orderkey % 10 <> 0 THEN 't' || o_orderkey % 2 END AS ty FROM orders),
cc AS (SELECT k, CASE c WHEN 0 THEN CASE WHEN sk = 1 THEN 'STOREFRONT_UPGRADE' ELSE 'UPGRADE' END WHEN 1 THEN 'UPGRADE' WHEN 2 THEN 'MODULE_SET' WHEN 3 THEN 'MODULE_LINKED' ELSE 'ROUTER_GLOBAL' END AS kind, CASE c WHEN 0 THEN source WHEN 1 THEN tok WHEN 2 THEN source || ':' || ty WHEN 3 THEN tok || ':' || ty ELSE source || ':' || ty END AS subject, CASE WHEN c <> 6 THEN a END AS after FROM b WHERE c < 7 AND (c <> 0 OR sk < 2) AND (c = 6 OR a IS NOT NULL))"""


@register("code_changes", f"WITH {CODE} SELECT k, kind, subject, lag(after) OVER (PARTITION BY kind, subject ORDER BY k) AS before, after FROM cc WHERE subject IS NOT NULL")
def code_changes(s, d):
    o, c = F.col("o_orderkey"), F.col("o_orderkey") % 8
    a, tok, ty = F.when(o % 11 != 0, hx(o % 13, 40)), hx(o % 6, 40), F.when(o % 10 != 0, F.concat(F.lit("t"), (o % 2).cast("string")))
    entry = lambda n, v: F.struct(F.lit(n).alias("k"), v.alias("v"))
    per = [[entry("implementation", a)], [entry("newImplementation", a), entry("token", tok)], [entry("moduleAddress", a), entry("typeId", ty)], [entry("moduleAddress", a), entry("moduleType", ty), entry("tokenAddress", tok)], [entry("globalImplementation", a), entry("typeId", ty)], [entry("newGlobalImplementation", a), entry("typeId", ty)], [entry("typeId", ty)], [entry("x", a)]]
    names = ["Upgraded", "TokenUpgraded", "SpecificRestrictionModuleSet", "ModuleLinked", "ModuleTypeRegistered", "GlobalImplementationUpdated", "ModuleTypeRemoved", "Transfer"]
    args = F.lit(None)
    for n, own in enumerate(per):
        args = F.when(c == n, F.map_from_entries(F.filter(F.array(*own), lambda x: x["v"].isNotNull()))).otherwise(args)
    sk = F.element_at(F.array(*[F.lit(x) for x in ("ARC_TOKEN", "STOREFRONT", "FACTORY")]), (o % 3 + 1).cast("int"))
    ev = table(s, d, "orders").select(o.alias("k"), hx(F.col("o_custkey") % 20, 40).alias("source"), sk.alias("source_kind"), F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int")).alias("event_name"), args.alias("args"))
    return seq.code_changes(ev, ["k"]).select("k", "kind", "subject", "before", "after")


@register("fan_out", "SELECT o_orderkey, n_nationkey AS asset FROM orders JOIN nation ON n_regionkey = o_custkey % 5")
def fan_out(s, d):
    return seq.fan_out(table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("source")), table(s, d, "nation").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("asset")), "source").drop("source")


@register("merge_by_position", "WITH m AS (SELECT o_orderkey // 3 AS block, o_custkey AS tx, o_orderkey AS log, 'a' AS source_name FROM orders UNION ALL SELECT l_orderkey // 3, l_partkey, l_orderkey, 'b' FROM lineitem) SELECT *, row_number() OVER (ORDER BY block, tx, log, source_name) AS rank FROM m")
def merge_by_position(s, d):
    a = table(s, d, "orders").select(F.floor(F.col("o_orderkey") / 3).alias("block"), F.col("o_custkey").alias("tx"), F.col("o_orderkey").alias("log"))
    b = table(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 3).alias("block"), F.col("l_partkey").alias("tx"), F.col("l_orderkey").alias("log"))
    return seq.merge_by_position({"b": b, "a": a}, ["block", "tx", "log"])


def rebuilt(s, d):
    assets = s.range(10).select(F.concat(F.lit("asset"), F.col("id").cast("string")).alias("asset_id"), hx(F.col("id") + 1000, 40).alias("token"), hx(F.col("id") + 2000, 40).alias("module"), hx(F.lit(3000), 40).alias("router"), F.lit(None).cast("string").alias("factory"), F.lit(None).cast("string").alias("storefront"))
    none = s.createDataFrame([], "asset_id string, address string")
    one = s.range(1)
    return audit.rebuild_all(audit_events(s, d), audit.Config(assets, none, none, none, one.select(hx(F.lit(5000), 40).alias("address")), one.select(hx(F.lit(3000), 40).alias("router")), "t"))


def ends(df):
    return df.withColumns({"from_log": F.col("from_pos.log"), "to_log": F.col("to_pos.log")}).drop("from_pos", "to_pos")


@register("rebuild_gate_interval", f"WITH {AUDIT}, {GATES} SELECT 'asset' || a AS asset_id, state, log AS from_log, to_log FROM g")
def rebuild_gate_interval(s, d):
    return ends(rebuilt(s, d)["gate_interval"])


@register("rebuild_allowlist_interval", f"""WITH {AUDIT}, m AS (SELECT a, block, tx, log, {H('event_id % 50 + 1', 40)} AS address, event_id % 5 <> 0 AS f FROM e WHERE event_type = 'signup'), l AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY a, address ORDER BY block, tx, log), false) AS was FROM m),
n AS (SELECT *, lead(log) OVER (PARTITION BY a, address ORDER BY block, tx, log) AS to_log FROM l WHERE f <> was) SELECT 'asset' || a AS asset_id, address, log AS from_log, to_log FROM n WHERE f""")
def rebuild_allowlist_interval(s, d):
    return ends(rebuilt(s, d)["allowlist_interval"])


@register("rebuild_exposure_window", f"""WITH {AUDIT}, {GATES}, xs AS (SELECT *, max(CAST(state AS INT)) OVER (PARTITION BY a ORDER BY block, tx, log ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gated FROM g), sp AS (SELECT * FROM xs WHERE NOT state AND gated = 1),
ls AS (SELECT DISTINCT a, {H('event_id % 50 + 1', 40)} AS address FROM e WHERE event_type = 'signup' AND event_id % 5 <> 0),
j AS (SELECT sp.a, sp.log AS from_log, sp.to_log, e.event_id, e.f, e.t, ls.address FROM sp LEFT JOIN e ON e.a = sp.a AND e.event_type = 'view' AND (e.block, e.tx, e.log) >= (sp.block, sp.tx, sp.log) AND (sp.to_log IS NULL OR (e.block, e.tx, e.log) < (sp.to_block, sp.to_tx, sp.to_log)) LEFT JOIN ls ON ls.a = e.a AND ls.address = e.t),
w AS (SELECT a, from_log, to_log, count(*) FILTER (f = {ZERO} AND t <> {ZERO}) AS mints, count(*) FILTER (t = {ZERO} AND f <> {ZERO}) AS burns, count(*) FILTER (f <> {ZERO} AND t <> {ZERO}) AS third_party, coalesce(list_sort(list(event_id) FILTER (f <> {ZERO} AND t <> {ZERO})), []) AS third_logs, coalesce(list_sort(list(DISTINCT t) FILTER (f <> {ZERO} AND t <> {ZERO} AND address IS NULL)), []) AS never_listed FROM j GROUP BY 1, 2, 3)
SELECT 'asset' || a AS asset_id, * EXCLUDE (a), CASE WHEN third_party > 0 THEN 'OTHER' WHEN mints > 0 AND burns > 0 THEN 'CLAWBACK' WHEN mints > 0 THEN 'ISSUANCE' ELSE 'OTHER' END AS kind FROM w""")
def rebuild_exposure_window(s, d):
    return ends(rebuilt(s, d)["exposure_window"]).withColumn("third_logs", F.array_sort(F.transform("third_party_positions", lambda p: p["log"]))).drop("third_party_positions")


@register("rebuild_holder_balance", f"""WITH {AUDIT}, m AS (SELECT a, block, f AS address, -v AS x FROM e WHERE event_type = 'view' AND v IS NOT NULL UNION ALL SELECT a, block, t, v FROM e WHERE event_type = 'view' AND v IS NOT NULL),
b AS (SELECT a, address, block, sum(x) AS x FROM m WHERE address <> {ZERO} GROUP BY 1, 2, 3) SELECT 'asset' || a AS asset_id, address, block, CAST(sum(x) OVER w AS VARCHAR) AS balance, sum(x) OVER w < 0 AS alarm FROM b WINDOW w AS (PARTITION BY a, address ORDER BY block)""")
def rebuild_holder_balance(s, d):
    return rebuilt(s, d)["holder_balance"].withColumn("balance", u256.to_string(F.col("balance")))


EPOCHS = f"""rt AS (SELECT block, tx, log, CASE WHEN event_id % 7 BETWEEN 1 AND 4 AND event_id % 5 > 1 THEN {H('event_id % 7', 40)} END AS m FROM e WHERE event_type = 'error' AND event_id % 4 <> 0 AND (event_id % 7 >= 3 OR (event_id % 3 <> 0 AND event_id % 5 <> 0))),
ep AS (SELECT * FROM (SELECT *, lead(block) OVER w AS to_block, lead(tx) OVER w AS to_tx, lead(log) OVER w AS to_log FROM rt WINDOW w AS (ORDER BY block, tx, log)) WHERE m IS NOT NULL)"""


@register("rebuild_router_epoch", f"WITH {AUDIT}, {EPOCHS} SELECT {H('3000', 40)} AS router, m AS module, log AS from_log, to_log FROM ep")
def rebuild_router_epoch(s, d):
    return ends(rebuilt(s, d)["router_sanctions_epoch"])


PAIRED = stack_sql("st", "SELECT block * 6 + tx AS g, log AS event_id, event_type = 'purchase' AS o FROM e WHERE event_type IN ('view', 'purchase')")


@register("rebuild_screening", f"WITH RECURSIVE {AUDIT}, {PAIRED} SELECT 'asset' || e.a AS asset_id, st.event_id AS transfer_event, st.m AS screening_event FROM st JOIN e ON e.event_id = st.event_id WHERE NOT st.o AND st.m IS NOT NULL")
def rebuild_screening(s, d):
    return rebuilt(s, d)["transfer_screening"].select("asset_id", "transfer_event", "screening_event")


@register("rebuild_screening_gap", f"WITH RECURSIVE {AUDIT}, {EPOCHS}, {PAIRED} SELECT 'asset' || e.a AS asset_id, st.event_id AS transfer_event, ep.m AS epoch_module FROM st JOIN e ON e.event_id = st.event_id JOIN ep ON (e.block, e.tx, e.log) >= (ep.block, ep.tx, ep.log) AND (ep.to_log IS NULL OR (e.block, e.tx, e.log) < (ep.to_block, ep.to_tx, ep.to_log)) WHERE NOT st.o AND st.m IS NULL")
def rebuild_screening_gap(s, d):
    return rebuilt(s, d)["screening_gap"].select("asset_id", "transfer_event", "epoch_module")


RESOLVED = f"""a AS (SELECT n_nationkey AS n, {H('n_nationkey + 1000', 40)} AS token, {H('n_nationkey % 3 + 3000', 40)} AS router, {H('1', 40)} AS factory, {H('n_nationkey % 2 + 4000', 40)} AS storefront, {H('9', 40)} AS market, CASE WHEN n_nationkey % 2 = 0 THEN {H('77', 40)} ELSE {H('0', 40)} END AS live FROM nation),
e AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 10 AS block FROM orders), r AS (SELECT token, min(block) AS first FROM e JOIN a ON e.k % 6 = 3 AND a.n = e.c % 20 GROUP BY 1), b AS (SELECT a.*, coalesce(first, 0) AS anchor FROM a LEFT JOIN r USING (token)),
ms AS (SELECT a.n, k, {H('c % 11 + 20', 40)} AS address, block, lead(block) OVER (PARTITION BY a.n, k % 12 ORDER BY k) AS last, k % 12 AS ty FROM e JOIN a ON k % 6 = 0 AND a.n = c % 20),
yt AS (SELECT a.n, a.token, {H('c % 9 + 50', 40)} AS address, block, lead(block) OVER (PARTITION BY a.n ORDER BY k) AS last FROM e JOIN a ON k % 6 = 1 AND a.n = c % 25),
pt AS (SELECT a.n, a.storefront, {H('c % 7 + 60', 40)} AS address, block, lead(block) OVER (PARTITION BY a.n ORDER BY k) AS last FROM e JOIN a ON k % 6 = 2 AND a.n % 2 = c % 2),
mk AS (SELECT DISTINCT a.n, a.market, {H('k', 64)} AS id, block FROM e JOIN a ON k % 6 = 4 AND a.n IN (c % 30, c % 25)),
u AS (SELECT n, 'ARC_TOKEN' AS source_kind, token AS address, anchor AS from_block, CAST(NULL AS BIGINT) AS to_block, 'none' AS filter_kind, CAST([] AS VARCHAR[]) AS filter_values FROM b UNION ALL SELECT n, 'ROUTER', router, anchor, NULL, 'none', [] FROM b UNION ALL SELECT n, 'FACTORY', factory, 0, NULL, 'none', [] FROM b UNION ALL SELECT n, 'STOREFRONT', storefront, 0, NULL, 'none', [] FROM b
UNION ALL SELECT n, 'GLOBAL_SANCTIONS', {H('5000', 40)}, anchor, NULL, 'none', [] FROM b WHERE n % 3 = 1 UNION ALL SELECT n, 'UV2_PAIR', {H('c_custkey + 7000', 40)}, c_custkey, NULL, 'none', [] FROM b JOIN customer ON c_nationkey = n
UNION ALL SELECT n, CASE ty WHEN 0 THEN 'AXIS1_MODULE' ELSE 'YIELD_BLACKLIST' END, address, block, last, 'none', [] FROM ms UNION ALL SELECT n, 'AXIS1_MODULE', live, anchor, NULL, 'none', [] FROM b WHERE n % 2 = 0 AND n NOT IN (SELECT n FROM ms WHERE ty = 0) UNION ALL SELECT n, 'YIELD_BLACKLIST', live, anchor, NULL, 'none', [] FROM b WHERE n % 2 = 0 AND n NOT IN (SELECT n FROM ms WHERE ty = 6)
UNION ALL SELECT n, 'YIELD_TOKEN', address, block, last, 'from', [token] FROM yt UNION ALL SELECT n, 'PURCHASE_TOKEN', address, block, last, 'touch', [storefront] FROM pt UNION ALL SELECT n, 'MORPHO', market, block, NULL, 'ids', list_sort(list(id) OVER (PARTITION BY n)) FROM mk)"""


@register("resolve_sources", f"WITH {RESOLVED} SELECT n AS asset_id, source_kind, address, from_block, to_block, filter_kind, filter_values FROM u")
def resolve_sources(s, d):
    n, k, c = F.col("n_nationkey"), F.col("o_orderkey"), F.col("o_custkey")
    token = lambda x: hx(x + 1000, 40)
    live = F.when(n % 2 == 0, hx(F.lit(77), 40)).otherwise(hx(F.lit(0), 40))
    assets = table(s, d, "nation").select(n.alias("asset_id"), token(n).alias("token"), hx(n % 3 + 3000, 40).alias("router"), hx(F.lit(1), 40).alias("factory"), hx(n % 2 + 4000, 40).alias("storefront"), hx(F.lit(9), 40).alias("market"), live.alias("live_module"), live.alias("live_blacklist"))
    names = ["SpecificRestrictionModuleSet", "YieldTokenUpdated", "PurchaseTokenUpdated", "TokenRegistered", "CreateMarket", "Transfer"]
    sources = [token(c % 20), token(c % 25), hx(c % 2 + 4000, 40), hx(F.lit(1), 40), hx(F.lit(9), 40), hx(F.lit(2), 40)]
    maps = [{"typeId": F.when(k % 12 == 0, "T").otherwise("Y"), "moduleAddress": hx(c % 11 + 20, 40)}, {"newYieldToken": hx(c % 9 + 50, 40)}, {"newPurchaseToken": hx(c % 7 + 60, 40)}, {"token": token(c % 20)}, {"id": hx(k, 64), "loanToken": token(c % 30), "collateralToken": token(c % 25)}, {"x": hx(k, 64)}]
    args = [F.map_from_entries(F.array(*[F.struct(F.lit(key).alias("k"), v.alias("v")) for key, v in m.items()])) for m in maps]
    at = lambda some: F.coalesce(*[F.when(k % 6 == i, x) for i, x in enumerate(some)])  # noqa: E731  the others are not made
    own = table(s, d, "orders").select(k.alias("event_id"), at(sources).alias("source"), at([F.lit(x) for x in names]).alias("event_name"), F.floor(k / 10).alias("block"), (k % 10).alias("tx"), k.alias("log"), at(args).alias("args"))
    sanctions = s.range(1).select(hx(F.lit(3001), 40).alias("router"), hx(F.lit(5000), 40).alias("address"))
    pools = table(s, d, "customer").select(token(F.col("c_nationkey")).alias("token"), hx(F.col("c_custkey") + 7000, 40).alias("address"), F.col("c_custkey").alias("first_block"))
    large_rows(s)
    return audit.resolve_sources(assets, own, sanctions, pools, "T", "Y")


@register("key_text", f"""WITH RECURSIVE a AS (SELECT c_custkey, CAST(c_custkey AS BIGINT) * 3000000019 * (c_custkey % 2) + c_custkey AS n FROM customer), t AS (SELECT c_custkey, n, n AS left_, '' AS s FROM a UNION ALL SELECT c_custkey, n, left_ // 58, substr('{hexabi.BASE58}', CAST(left_ % 58 AS INTEGER) + 1, 1) || s FROM t WHERE left_ > 0)
SELECT c_custkey, repeat('1', 32 - CASE WHEN n = 0 THEN 0 ELSE CAST((length(to_hex(n)) + 1) // 2 AS INTEGER) END) || s AS key FROM t WHERE left_ = 0""")
def key_text(s, d):
    c = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", hexabi.bytes32_to_base58(hx(c * 3_000_000_019 * (c % 2) + c, 64)).alias("key"))


# ---- pages


@register("list_txs", f"WITH {TXS} SELECT k, true AS has_more FROM x WHERE origination = 'ecdsa' AND k % 9 <> 2 AND (slot_number, tx_idx) < (500, 3) ORDER BY slot_number DESC, tx_idx DESC LIMIT 50")
def list_txs(s, d):
    k = F.col("k")
    feed = txs(s, d).withColumn("is_oracle", F.when(k % 9 == 2, True).when(k % 9 == 1, False))
    return pages.list_page("txs", feed, 50, [500, 3], origination="ecdsa").select("k", "has_more")


@register("list_crossings", f"WITH {TXS} SELECT k, true AS has_more FROM x WHERE k % 3 <> 0 AND k % 2 = 0 ORDER BY slot_number DESC, tx_idx DESC LIMIT 30")
def list_crossings(s, d):
    k = F.col("k")
    own = txs(s, d).withColumns({"seams": F.when(k % 2 == 0, F.array(F.lit("bridge"), F.lit("sol_to_evm"))).otherwise(F.array(F.lit("evm_to_sol"))), "is_oracle": k % 3 == 0})
    return pages.list_page("crossings", own, 30, seams="bridge").select("k", "has_more")


@register("list_tokens", f"SELECT {H('p_partkey', 40)} AS address, true AS has_more FROM part WHERE p_partkey % 3 = 1 ORDER BY 1 DESC LIMIT 20")
def list_tokens(s, d):
    n = F.col("p_partkey")
    return pages.list_page("tokens", table(s, d, "part").select(hx(n, 40).alias("address"), F.lit(None).cast("string").alias("factory"), F.when(n % 3 == 0, "ERC-20").when(n % 3 == 1, "SPL").alias("kind")), 20, kind="SPL").select("address", "has_more")


@register("list_addresses", "SELECT address, true AS has_more FROM (SELECT lower(to_hex(c_custkey)) AS address, c_name, c_custkey % 50 AS txs, CASE c_custkey % 3 WHEN 0 THEN 'token' ELSE 'eoa' END AS kind FROM customer) WHERE kind = 'eoa' AND (contains(address, '1') OR contains(lower(c_name), '1')) AND (txs, address) < (40, 'f') ORDER BY txs DESC, address DESC LIMIT 20")
def list_addresses(s, d):
    c = F.col("c_custkey")
    own = table(s, d, "customer").select(F.lower(F.hex(c)).alias("address"), F.col("c_name").alias("label"), (c % 50).alias("txs"), F.when(c % 3 == 0, "token").otherwise("eoa").alias("kind"))
    return pages.list_page("addresses", own, 20, [40, "f"], "1", kind="eoa").select("address", "has_more")


@register("list_audit_events", f"WITH {AUDIT} SELECT event_id, true AS has_more FROM e WHERE event_type = 'view' ORDER BY block DESC, tx DESC, log DESC LIMIT 25")
def list_audit_events(s, d):
    own = audit_events(s, d).withColumnsRenamed({"block": "block_number", "tx": "tx_index", "log": "log_index"})
    return pages.list_page("audit_events", own, 25, event_name="Transfer", source_kind="ARC_TOKEN").select("event_id", "has_more")


def positions(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("block"), F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("block_hash"), F.col("l_linenumber").alias("tx_index"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("tx_hash"))


MOST = "(SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def fullest(s, d):
    top = table(s, d, "lineitem").groupBy("l_orderkey").count().orderBy(F.desc("count"), "l_orderkey").first()
    return -1 if top is None else top[0]


@register("block_positions", f"SELECT l_linenumber AS tx_index, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS tx_hash FROM lineitem WHERE l_orderkey = {MOST}")
def block_positions(s, d):
    return pages.block_positions(positions(s, d), fullest(s, d)).select("tx_index", "tx_hash")


@register("block_tx_count", f"SELECT count(*) AS txs FROM lineitem WHERE l_orderkey = {MOST}")
def block_tx_count(s, d):
    return pages.block_tx_count(positions(s, d), block_hash=f"H{fullest(s, d)}")


@register("block_receipts", f"SELECT l_linenumber AS tx_index, CASE WHEN l_linenumber <> 2 THEN CAST(l_partkey AS VARCHAR) END AS receipt_params FROM lineitem WHERE l_orderkey = {MOST}")
def block_receipts(s, d):
    receipts = table(s, d, "lineitem").where("l_linenumber <> 2").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("tx_hash"), F.col("l_partkey").cast("string").alias("receipt_params")).dropDuplicates(["tx_hash"])
    return pages.block_receipts(positions(s, d), receipts, fullest(s, d)).select("tx_index", "receipt_params")


@register("block_detail", f"SELECT l_orderkey AS block, count(*) AS txs, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS gas FROM lineitem WHERE l_orderkey = {MOST} GROUP BY 1")
def block_detail(s, d):
    legs = table(s, d, "lineitem").select(F.col("l_orderkey").alias("block"), "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return pages.block_detail(aggs.block_list(table(s, d, "orders").select(F.col("o_orderkey").alias("block")), legs, "block", "l_returnflag", ["A"], "q"), fullest(s, d)).select("block", "txs", "gas")


@register("token_detail", "SELECT '0xa3' AS token, count(*) FILTER (c_acctbal > 0) AS holders, 's3' AS supply FROM customer WHERE c_nationkey = 3")
def token_detail(s, d):
    names = table(s, d, "nation").select(F.concat(F.lit("0xa"), F.col("n_nationkey").cast("string")).alias("token"))
    counts = table(s, d, "customer").where("c_acctbal > 0").groupBy(F.concat(F.lit("0xa"), F.col("c_nationkey").cast("string")).alias("token")).agg(F.count("*").alias("holders"))
    return pages.token_detail(names, counts, names.withColumn("supply", F.concat(F.lit("s"), F.substring("token", 4, 9))), "0xA3")


@register("hook_detail", f"SELECT CAST({MOST} AS VARCHAR) AS sol_signature, list_sort(list(l_linenumber || ':' || l_suppkey)) AS hooks FROM lineitem WHERE l_orderkey = {MOST}")
def hook_detail(s, d):
    runs = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("sol_signature"), F.col("l_linenumber").alias("idx"), F.col("l_suppkey").cast("string").alias("hook_address"), F.col("l_returnflag").alias("result"))
    got = pages.hook_detail(table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("sol_signature")), runs, str(fullest(s, d)))
    return got.select("sol_signature", F.transform("hooks", lambda h: F.concat_ws(":", h["idx"].cast("string"), h["hook_address"])).alias("hooks"))


@register("trace_detail", f"SELECT {H(MOST, 64)} AS tx_hash, count(*) AS n FROM lineitem WHERE l_orderkey = {MOST}")
def trace_detail(s, d):
    traces = table(s, d, "lineitem").groupBy(hx(F.col("l_orderkey"), 64).alias("tx_hash")).agg(F.count("*").alias("n"))
    return pages.trace_detail(traces, "0x" + f"{fullest(s, d):064X}")


@register("address_detail", f"""SELECT {H('c_custkey', 40)} AS address, coalesce(n, 0) AS txs, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS label, CASE WHEN c_custkey % 6 = 0 THEN 'creator' END AS creator, CASE WHEN c_custkey % 5 = 0 THEN 'own' END AS owner, c_custkey % 7 = 0 AS is_token,
CASE WHEN c_custkey = 0 THEN 'burn' WHEN c_custkey BETWEEN 1 AND 10 THEN 'precompile_eth' WHEN c_custkey % 7 = 0 THEN 'token' WHEN c_custkey % 4 = 0 THEN 'contract' WHEN c_custkey % 5 = 0 THEN 'account' ELSE 'eoa' END AS kind FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def address_detail(s, d):
    c = F.col("c_custkey")
    own = table(s, d, "customer").select("c_custkey", "c_name", hx(c, 40).alias("address"))
    stats = table(s, d, "orders").groupBy(hx(F.col("o_custkey"), 40).alias("address")).agg(F.count("*").alias("txs"))
    got = pages.address_detail(own.select("address"), stats, own.where("c_custkey % 4 = 0").select("address", F.col("c_name").alias("label"), F.lit(True).alias("has_code")), own.where("c_custkey % 5 = 0").select("address", F.lit("own").alias("owner")), own.where("c_custkey % 7 = 0"), own.where("c_custkey % 6 = 0").select("address", F.lit("creator").alias("creator")))
    return got.select("address", "txs", "label", "creator", "owner", "is_token", "kind")


@register("ordered_legs", "SELECT l_orderkey AS slot_number, l_linenumber AS tx_idx, l_suppkey AS instr_idx FROM lineitem")
def ordered_legs(s, d):
    return pages.ordered_legs(table(s, d, "lineitem").select(F.col("l_orderkey").alias("slot_number"), F.col("l_linenumber").alias("tx_idx"), F.col("l_suppkey").alias("instr_idx")))


# ---- scope, gaps, reconciliation


@register("discover_tokens", "SELECT DISTINCT l_partkey AS token FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_partkey % 3 = 0")
def discover_tokens(s, d):
    li = table(s, d, "lineitem").withColumnRenamed("l_partkey", "token")
    return reconcile.discover(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), table(s, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("token")), "token")


@register("merge_sources", "SELECT l_suppkey AS address, CASE min(CASE l_linenumber WHEN 7 THEN 1 WHEN 6 THEN 2 ELSE 3 END) WHEN 1 THEN 'ARC_TOKEN' WHEN 2 THEN 'ROUTER' ELSE 'MORPHO' END AS kind, list_sort(list(DISTINCT CASE WHEN l_partkey % 7 = 0 THEN 'none' ELSE 'f' || l_partkey % 3 END)) AS filters, bool_or(l_partkey % 7 = 0) AS open FROM lineitem GROUP BY 1")
def merge_sources(s, d):
    mode = F.col("l_linenumber")
    own = table(s, d, "lineitem").select(F.col("l_suppkey").alias("address"), F.when(mode == 7, "ARC_TOKEN").when(mode == 6, "ROUTER").otherwise("MORPHO").alias("kind"), F.when(F.col("l_partkey") % 7 == 0, "none").otherwise(F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string"))).alias("filter"))
    return reconcile.merge_sources(own, F.when(F.col("kind") == "ARC_TOKEN", 1).when(F.col("kind") == "ROUTER", 2).otherwise(3))


@register("manifest", """WITH r AS (SELECT c_nationkey AS asset, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS h, 0 AS b FROM customer), p AS (SELECT asset, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY asset) SELECT asset, sha256(h) AS manifest FROM p""")
def manifest(s, d):
    return reconcile.manifest(table(s, d, "customer").withColumnRenamed("c_nationkey", "asset"), ["asset"], ["c_mktsegment", "c_custkey"], buckets=1)


@register("detect_gaps_new", "SELECT l_suppkey AS address, l_returnflag AS filter, min(l_orderkey) AS from_block, 5000 AS to_block FROM lineitem WHERE (l_suppkey, l_returnflag) NOT IN (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_suppkey % 3 > 0 AND l_returnflag <> 'N') GROUP BY 1, 2 HAVING min(l_orderkey) <= 5000")
def detect_gaps_new(s, d):
    own = table(s, d, "lineitem").select(F.col("l_suppkey").alias("address"), F.col("l_returnflag").alias("filter"), F.col("l_orderkey").alias("from_block"))
    return reconcile.detect_gaps(own, own.where("address % 3 > 0 AND filter <> 'N'").select("address", "filter").distinct(), 5000)


@register("reopened_gaps", "SELECT c_custkey AS address, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN least(c_custkey, 50) WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 50 END AS from_block, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN greatest(c_custkey + 10, 60) WHEN c_custkey % 2 = 0 THEN c_custkey + 10 ELSE 60 END AS to_block FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def reopened_gaps(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("address"))
    return reconcile.reopen_gaps(c.where("address % 2 = 0").select("address", F.col("address").alias("from_block"), (F.col("address") + 10).alias("to_block")), c.where("address % 3 = 0").select("address", F.lit(50).cast("bigint").alias("from_block"), F.lit(60).cast("bigint").alias("to_block")), ["address"])


@register("gap_plan", "WITH g AS (SELECT c_custkey AS address, c_custkey * 7 AS from_block, c_custkey * 7 + c_custkey % 40 AS to_block FROM customer), j AS (SELECT g.*, min(o_orderkey // 8) AS from_slot, max(o_orderkey // 8) AS to_slot FROM g LEFT JOIN orders ON o_orderkey % 5 <> 0 AND o_orderkey BETWEEN from_block AND to_block GROUP BY ALL) SELECT *, CASE WHEN to_slot IS NULL THEN 'done' WHEN from_slot < 20 THEN 'source_pruned' ELSE 'open' END AS status FROM j")
def gap_plan(s, d):
    k = F.col("k")
    c = F.col("c_custkey")
    gaps = table(s, d, "customer").select(c.alias("address"), (c * 7).alias("from_block"), (c * 7 + c % 40).alias("to_block"))
    return reconcile.gap_plan(gaps, txs(s, d).where("k % 5 <> 0").select(k.alias("block"), F.col("slot_number").alias("slot")), 20, ["address"], width=64)


@register("reconcile_cursor", f"""WITH {TXS}, st AS (SELECT tx_hash, k * 2 AS v FROM x WHERE k % 3 <> 0 AND slot_number <= 500), fr AS (SELECT tx_hash, k, CASE WHEN k % 4 = 0 THEN k ELSE k * 2 END AS v FROM x WHERE k % 2 = 0 AND slot_number <= 500)
SELECT coalesce(st.tx_hash, fr.tx_hash) AS tx_hash, st.v AS stored, fr.v AS fresh, CASE WHEN fr.k % 7 = 0 THEN 'missing' WHEN st.tx_hash IS NULL THEN 'missing' WHEN fr.tx_hash IS NULL THEN 'unconfirmed' WHEN st.v = fr.v THEN 'unchanged' ELSE 'healed' END AS status FROM st FULL JOIN fr ON st.tx_hash = fr.tx_hash""")
def reconcile_cursor(s, d):
    k = F.col("k")
    x = txs(s, d)
    stored = x.where("k % 3 <> 0 AND slot_number <= 500").select("tx_hash", (k * 2).alias("v"))
    fresh = x.where("k % 2 = 0").select("tx_hash", F.when(k % 4 == 0, k).otherwise(k * 2).alias("v"), "slot_number")
    return reconcile.reconcile_transfers(stored, fresh, x.where("k % 7 <> 0").select("tx_hash", k.alias("block_number")), ["tx_hash"], "v", "slot_number", 500).drop("block_number")


@register("reconcile_balances", "SELECT c_custkey, c_custkey % 5 AS observed, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END AS stored, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN 'delete' WHEN coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END, 0) = c_custkey % 5 THEN 'ok' ELSE 'heal' END AS action, c_custkey % 5 - coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END, 0) AS drift FROM customer")
def reconcile_balances(s, d):
    c = F.col("c_custkey")
    own = table(s, d, "customer").select("c_custkey")
    return reconcile.reconcile_balances(own.where(c % 3 != 0).withColumn("balance", c % 4), own.withColumn("balance", c % 5), ["c_custkey"])


@register("label_candidates", "SELECT c_custkey AS address FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 > 1 AND (c_custkey % 3 = 0 OR c_custkey % 20 > 7)")
def label_candidates(s, d):
    c = F.col("c_custkey")
    now = F.timestamp_seconds(F.lit(1_000_000_000))
    own = table(s, d, "customer").select(c.alias("address"), (c % 2 == 0).alias("has_code"), F.when(c % 5 == 0, "verified").when(c % 5 == 1, "registry").otherwise("probe").alias("provenance"), F.when(c % 3 != 0, now - F.make_interval(days=(c % 20).cast("int"))).alias("verified_checked_at"))
    return reconcile.label_candidates(own, now, 7).select("address")


@register("incomplete_metadata", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def incomplete_metadata(s, d):
    n = F.col("p_partkey")
    return reconcile.incomplete_metadata(table(s, d, "part").select("p_partkey", F.when(n % 2 != 0, "n").alias("name"), F.when(n % 3 != 0, "k").alias("kind"), F.when(n % 5 != 0, True).alias("gated"))).select("p_partkey")


@register("evidence_merge", "SELECT c_custkey AS ref, c_custkey % 3 AS body, CASE WHEN c_custkey % 7 = 0 THEN 'has_name' WHEN c_custkey % 11 = 0 THEN 'long' END AS broken, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'invalid' WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 1 THEN 'existing' WHEN c_custkey % 2 = 0 THEN 'conflict' ELSE 'new' END AS verdict FROM customer")
def evidence_merge(s, d):
    c = F.col("c_custkey")
    own = table(s, d, "customer").select(c.alias("ref"), (c % 3).alias("body"))
    n = F.col("ref")
    return reconcile.evidence_merge(own.where("ref % 2 = 0").withColumn("body", F.lit(1).cast("bigint")), own.unionByName(own.where("ref % 4 = 0")), ["ref"], "body", {"has_name": n % 7 != 0, "long": n % 11 != 0})


@register("hold_valve", """SELECT c_nationkey AS worker, CASE c_nationkey % 4 WHEN 0 THEN 9000 WHEN 1 THEN m - 1 WHEN 2 THEN m ELSE m - 1 END AS persist, CASE WHEN c_nationkey % 4 IN (1, 3) THEN m - 1 END AS cursor, CASE c_nationkey % 4 WHEN 1 THEN 6 WHEN 3 THEN 1 END AS streak, CASE WHEN c_nationkey % 4 = 2 THEN m END AS gave_up FROM (SELECT c_nationkey, min(c_custkey) AS m FROM customer GROUP BY 1)""")
def hold_valve(s, d):
    """Workers without a miss, with a transient one held long, a terminal one held long, a terminal one held elsewhere before."""
    w = F.col("worker")
    own = table(s, d, "customer").select(F.col("c_nationkey").alias("worker"), F.col("c_custkey").alias("slot"))
    first = own.groupBy("worker").agg(F.min("slot").alias("m"))
    held = first.select("worker", F.when(w % 4 == 3, F.col("m") + 7).otherwise(F.col("m") - 1).alias("cursor"), F.lit(5).cast("bigint").alias("streak"))
    got = reconcile.hold_valve(own.where("worker % 4 > 0").withColumn("terminal", w % 4 != 1), held, first.select("worker", F.lit(9000).cast("bigint").alias("planned")), 6)
    return got


@register("search_token_kind", "SELECT kind, key, CASE WHEN kind = 'token' AND CAST(key AS BIGINT) % 2 = 0 THEN 'SPL' END AS token_kind FROM (SELECT 'token' AS kind, CAST(p_partkey AS VARCHAR) AS key FROM part UNION ALL SELECT 'address', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'block', CAST(s_suppkey AS VARCHAR) FROM supplier)")
def search_token_kind(s, d):
    from slotline.plans.queries import index

    return search.with_token_kind(index(s, d), table(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("address"), F.lit("SPL").alias("token_kind"))).select("kind", "key", "token_kind")


RANGES = ((0, 10**9), (777, 9001), (4096, 8192), (5000, 5003))


@register("range_histogram", f"WITH {POINTS}, r(lo, hi) AS (VALUES {', '.join(map(str, RANGES))}) SELECT lo, CASE WHEN total <= 0 THEN '0' WHEN total = 1 THEN '1' WHEN total <= 5 THEN '2-5' WHEN total <= 20 THEN '6-20' WHEN total <= 50 THEN '21-50' ELSE '50+' END AS bucket, count(*) AS blocks FROM q JOIN r ON block >= lo AND block < hi GROUP BY 1, 2")
def range_histogram(s, d):
    """Histograms of four ranges of blocks from one pyramid."""
    p = written(order_points(s, d))
    held = written(rollup.pyramid(p))
    out = [rollup.range_histogram(p, held, lo, hi).select(F.lit(lo).alias("lo"), "bucket", "blocks") for lo, hi in RANGES]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@register("init_watermark", "SELECT c_nationkey, greatest(-1, least(max(c_custkey), min(c_custkey) + 500) - 64) AS watermark FROM customer GROUP BY 1")
def init_watermark(s, d):
    """Where a worker begins: ``lag`` behind the lower of source tip and production, never below -1."""
    ends_ = table(s, d, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("tip"), (F.min("c_custkey") + 500).alias("produced"))
    return ends_.select("c_nationkey", reconcile.init_watermark(F.col("tip"), F.col("produced"), 64).alias("watermark"))


@register("stream_sessions", f"""WITH o AS (SELECT user_id, {SEC} AS sec, lag({SEC}) OVER (PARTITION BY user_id ORDER BY {SEC}) AS was FROM events), n AS (SELECT *, sum(CASE WHEN was IS NULL OR sec >= was + 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(sec) AS start, count(*) AS n FROM n GROUP BY user_id, k""")
def stream_sessions(s, d):
    """Sessions of each user, a day without an event apart."""
    path = scratch(s)
    own = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]").select(F.timestamp_seconds(F.unix_timestamp("ts")).alias("ts"), "user_id")
    counted = streams.session_counts(own, "ts", "1 day", "1 day", ["user_id"]).select("user_id", F.unix_timestamp("session.start").alias("start"), "n")
    counted.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/rows")).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/rows")


# ---- streams: each runs over a table's files until all are read; the folder it fills is the result


def run(s, d, name, apply, *columns):
    path = scratch(s)
    own = s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")
    streams.run_available(own.select(*columns) if columns else own, apply(path), f"{path}/_progress").awaitTermination()
    return path


@register("stream_mirror", "SELECT event_id, user_id, event_type FROM events")
def stream_mirror(s, d):
    path = run(s, d, "events", lambda p: streams.mirror_into(f"{p}/rows", ["event_id"], "event_id", 10**9), "event_id", "user_id", "event_type")
    return s.read.parquet(f"{path}/rows").drop("batch")


@register("stream_balances", "WITH m AS (SELECT o_custkey AS h, -CAST(o_orderkey AS HUGEINT) AS x FROM orders UNION ALL SELECT o_orderkey % 50, o_orderkey FROM orders) SELECT 'T' AS token, " + H("h", 40) + " AS holder, CAST(sum(x) AS VARCHAR) AS balance FROM m WHERE h <> 0 GROUP BY h HAVING sum(x) <> 0")
def stream_balances(s, d):
    o = F.col("o_orderkey")
    path = run(s, d, "orders", lambda p: streams.balances_into(p, ["o_orderkey"]), o, F.lit("T").alias("token"), hx(F.col("o_custkey"), 40).alias("sender"), hx(o % 50, 40).alias("receiver"), u256.from_long(o).alias("amount"))
    return streams.balances(s, path).withColumn("balance", u256.to_string(F.col("balance")))


@register("stream_address_stats", "SELECT o_custkey, count(*) AS txs, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def stream_address_stats(s, d):
    path = run(s, d, "orders", lambda p: streams.address_stats_into(p, "o_orderkey", "o_orderkey", ["o_custkey"]))
    return streams.address_stats_of(s, path).select(F.col("address").alias("o_custkey"), "txs", F.col("first_seen").alias("first"), F.col("last_seen").alias("last"))


@register("stream_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'late' ELSE o_orderstatus END AS status, o_custkey AS owner, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey END AS extra FROM orders UNION ALL SELECT -o_orderkey - 1, 'late', o_custkey, o_custkey FROM orders WHERE o_orderkey % 100 = 0")
def stream_merge(s, d):
    """A stream of all orders merged into a bucketed table, then a batch that changes a tenth of them and adds some, twice."""
    shape = s.createDataFrame([], "o_orderkey bigint, status string, owner bigint, extra bigint").schema
    o, bucket = F.col("o_orderkey"), buckets.by_range("o_orderkey", 12)
    apply = lambda p: streams.merge_into(p, shape, bucket, lambda old, new: merge.upsert_merge(old, new, ["o_orderkey"], {"status": "replace", "extra": "fill"}))
    path = run(s, d, "orders", apply, o.cast("bigint").alias("o_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("bigint").alias("owner"), F.lit(None).cast("bigint").alias("extra"))
    c = F.col("o_custkey").cast("bigint")
    changed = table(s, d, "orders").where(o % 10 == 0).select(o.cast("bigint").alias("o_orderkey"), F.lit("late").alias("status"), c.alias("owner"), c.alias("extra"))
    added = table(s, d, "orders").where(o % 100 == 0).select((-o - 1).cast("bigint").alias("o_orderkey"), F.lit("late").alias("status"), c.alias("owner"), c.alias("extra"))
    for _ in range(2):
        apply(path)(changed.unionByName(added), 1000)
    return streams.merged(s, path, shape, bucket)


@register("stream_recheck", "SELECT o_orderkey, coalesce(bool_or(l_orderkey + l_partkey % 900 BETWEEN o_orderkey AND o_orderkey + 500), false) AS resolved FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND o_orderkey < (SELECT max(o_orderkey) FROM orders) - 3000 GROUP BY 1")
def stream_recheck(s, d):
    """Open orders wait 500 positions for a line of theirs that is seen late; what is near the end of the streams is still open."""
    path = scratch(s)
    feed = table(s, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    late = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_orderkey") + F.col("l_partkey") % 900).alias("seen"))
    own = streams.in_steps(path, {"feed": (feed, "o_orderkey"), "late": (late, "seen")})
    kind = lambda df, at, late: df.select("o_orderkey", F.col(at).alias("at"), F.lit(late).alias("_late"))
    both = kind(own["feed"], "o_orderkey", False).unionByName(kind(own["late"], "seen", True))
    streams.run_available(both, streams.recheck_pairs_into(f"{path}/found", ["o_orderkey"], "at", 500), f"{path}/_progress").awaitTermination()
    tip = table(s, d, "orders").agg(F.max("o_orderkey").alias("tip"))
    rows = s.read.schema("o_orderkey bigint, resolved boolean, open boolean").parquet(f"{path}/found/rows").where("NOT open")
    return rows.join(F.broadcast(tip)).where("o_orderkey < tip - 3000").groupBy("o_orderkey").agg(F.bool_or("resolved").alias("resolved"))  # one row


@register("stream_windows", f"SELECT {SEC} // 86400 * 86400 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    path = scratch(s)
    own = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    counted = streams.windowed_counts(own.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 day", None, ["event_type"]).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")
    counted.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/rows")).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/rows")


@register("stream_throughput", f"""WITH p AS (SELECT o_orderkey AS block, o_orderkey * 30 AS ts, o_custkey % 50 AS total, o_custkey % 20 AS app FROM orders), w AS (SELECT first_value(block) OVER r AS from_block, block AS to_block, ts - first_value(ts) OVER r AS elapsed, CAST(sum(total) OVER r AS BIGINT) AS total, CAST(sum(app) OVER r AS BIGINT) AS app, count(*) OVER r AS n FROM p WINDOW r AS (ORDER BY block ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW))
SELECT from_block, to_block, elapsed, total, app FROM w WHERE n = {W} AND elapsed >= 60 ORDER BY app / elapsed DESC, from_block LIMIT {5 * (2 * W - 1)}""")
def stream_throughput(s, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    path = run(s, d, "orders", lambda p: lambda batch, n: streams.record_into(p, 5, W, 60)(batch, 0), o.alias("block"), (o * 30).alias("ts"), (c % 50).alias("total"), (c % 20).alias("app"))
    return s.read.parquet(f"{path}/record").select("from_block", "to_block", "elapsed", "total", "app")


@register("stream_notify", "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM orders GROUP BY 1")
def stream_notify(s, d):
    path = run(s, d, "orders", lambda p: streams.announce_into(f"{p}/rows", ["o_custkey"], "o_orderkey", "o_orderpriority", "oracle"), "*", (F.col("o_orderstatus") == "F").alias("oracle"))
    return s.read.parquet(f"{path}/rows").groupBy("o_custkey").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


@register("late_recheck", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders) - 5000 AND o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def late_recheck(s, d):
    feed = table(s, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done"))
    path = run(s, d, "lineitem", lambda p: streams.recheck_into(f"{p}/rows", lambda: feed, ["o_orderkey"], "o_orderkey", 5000, "done"), F.col("l_orderkey").alias("o_orderkey"))
    return s.read.parquet(f"{path}/rows").select("o_orderkey").distinct()


LOOKS = f"a AS (SELECT {SEC} // 3600 AS h, count(*) AS n FROM events WHERE event_id % 911 <> 910 GROUP BY 1), b AS (SELECT {SEC} // 3600 AS h, count(*) AS n FROM events GROUP BY 1), t AS (SELECT max(h) AS tip FROM b)"


@register("stream_watermark", f"WITH {LOOKS} SELECT coalesce(min(CASE WHEN tip - b.h < 24 OR a.n IS DISTINCT FROM b.n THEN b.h END), max(b.h) + 1) - 1 AS watermark FROM b LEFT JOIN a USING (h), t")
def stream_watermark(s, d):
    """Two looks as two batches; the first passes nothing, the second what has not changed."""
    path = scratch(s)
    look = lambda x: x.groupBy(F.floor(F.col("sec") / 3600).alias("h")).agg(F.count("*").alias("n"))
    apply = streams.watermark_into(path, "h", "n", 24)
    ev = events(s, d)
    apply(look(ev.where("event_id % 911 <> 910")), 0)
    apply(look(ev), 1)
    return s.read.parquet(f"{path}/watermark").where("batch = 1").select("watermark")


@register("stream_hold", "SELECT c_nationkey AS worker, m AS slot FROM (SELECT c_nationkey, min(c_custkey) AS m FROM customer GROUP BY 1) WHERE c_nationkey % 2 = 0")
def stream_hold(s, d):
    """Three polls with the same misses and a hold of three: terminal ones end as dead letters, transient ones stay held."""
    path = scratch(s)
    own = table(s, d, "customer").select(F.col("c_nationkey").alias("worker"), F.col("c_custkey").alias("slot"), (F.col("c_nationkey") % 2 == 0).alias("terminal"))
    planned = lambda n: own.select("worker").distinct().withColumn("planned", F.lit(10**9))
    for n in range(3):
        streams.hold_into(path, planned, 3)(own, n)
    return s.read.parquet(f"{path}/dead").select("worker", "slot")
