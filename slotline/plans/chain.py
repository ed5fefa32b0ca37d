"""Chain-shaped inputs made of the given tables' keys, in Spark and in SQL: transactions from orders, logs from lineitems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.sources.io import table


def hx(c: Column, n: int) -> Column:
    """0x and ``n`` digits."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), n, "0"))


def H(x: str, n: int) -> str:
    return f"('0x' || lpad(lower(to_hex({x})), {n}, '0'))"


def txs(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(s, d, "orders").select(
        F.lit(1).cast("bigint").alias("chain_id"), k.alias("k"), hx(k, 64).alias("tx_hash"),
        F.floor(k / 8).alias("slot_number"), (k % 2).alias("slot_block_idx"), (k % 8).alias("tx_idx"),
        F.when(k % 3 != 0, hx(c, 40)).alias("from_addr"), hx(c + 1, 40).alias("from_address"),
        F.when(k % 5 != 0, hx(k % 17, 40)).alias("to_addr"), F.when(k % 4 != 0, hx(k % 30, 8)).alias("method_id"),
        F.when(k % 6 == 0, "solana_unsigned").when(k % 6 == 1, "solana_ed25519").otherwise("ecdsa").alias("origination"),
        F.when((k % 6 < 2) & (k % 4 != 1), F.concat(F.lit("sol"), c.cast("string"))).alias("solana_signer"),
        (k % 10).alias("input_len"), F.unix_timestamp("o_orderdate").alias("ts"),
    )


TXS = f"""x AS (SELECT CAST(1 AS BIGINT) AS chain_id, o_orderkey AS k, {H('o_orderkey', 64)} AS tx_hash, o_orderkey // 8 AS slot_number, o_orderkey % 2 AS slot_block_idx, o_orderkey % 8 AS tx_idx,
CASE WHEN o_orderkey % 3 <> 0 THEN {H('o_custkey', 40)} END AS from_addr, {H('o_custkey + 1', 40)} AS from_address, CASE WHEN o_orderkey % 5 <> 0 THEN {H('o_orderkey % 17', 40)} END AS to_addr,
CASE WHEN o_orderkey % 4 <> 0 THEN {H('o_orderkey % 30', 8)} END AS method_id, CASE o_orderkey % 6 WHEN 0 THEN 'solana_unsigned' WHEN 1 THEN 'solana_ed25519' ELSE 'ecdsa' END AS origination,
CASE WHEN o_orderkey % 6 < 2 AND o_orderkey % 4 <> 1 THEN 'sol' || o_custkey END AS solana_signer, o_orderkey % 10 AS input_len, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, o_custkey FROM orders)"""


def audit_events(s: SparkSession, d: str) -> DataFrame:
    """The event table as an audit's: ten assets' gates, transfers, lists, screenings and router events."""
    e, a = F.col("event_id"), F.col("user_id") % 10
    sec = F.unix_timestamp("ts")
    kind = F.col("event_type")
    zero = hx(F.lit(0), 40)
    maps = {
        "click": {"transfersAllowed": (e % 2 == 0).cast("string")},
        "view": {"from": F.when(e % 3 == 0, zero).otherwise(hx(e % 30 + 1, 40)), "to": F.when(e % 4 == 0, zero).otherwise(hx(e % 50 + 1, 40)), "value": F.when(e % 13 != 0, hx(e, 64))},
        "signup": {"account": hx(e % 50 + 1, 40), "isWhitelisted": (e % 5 != 0).cast("string")},
        "purchase": {"from": zero},
        "error": {"typeId": F.when(e % 4 != 0, "t").otherwise("u"), "isGlobal": (e % 3 != 0).cast("string"), "globalImplementation": F.when(e % 5 == 1, zero).when(e % 5 > 1, hx(e % 7, 40)), "newGlobalImplementation": F.when(e % 5 == 1, zero).when(e % 5 > 1, hx(e % 7, 40))},
    }
    args = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    for name, own in maps.items():
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in own.items()])
        args = F.when(kind == name, F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))).otherwise(args)
    source = F.when(kind.isin("click", "signup"), hx(a + 2000, 40)).when(kind == "view", hx(a + 1000, 40)).when(kind == "purchase", hx(F.lit(5000), 40)).otherwise(hx(F.lit(3000), 40))
    router = F.when(e % 7 < 3, "ModuleTypeRegistered").when(e % 7 < 5, "GlobalImplementationUpdated").otherwise("ModuleTypeRemoved")
    name = F.when(kind == "click", "TransfersRestrictionToggled").when(kind == "view", "Transfer").when(kind == "signup", "WhitelistStatusChanged").when(kind == "purchase", "TransferScreened").otherwise(router)
    sort = F.when(kind.isin("click", "signup"), "AXIS1_MODULE").when(kind == "view", "ARC_TOKEN").when(kind == "purchase", "GLOBAL_SANCTIONS").otherwise("ROUTER")
    return table(s, d, "events").select("event_id", source.alias("source"), sort.alias("source_kind"), name.alias("event_name"), F.floor(sec / 3600).alias("block"), (F.floor(sec / 600) % 6).alias("tx"), e.alias("log"), F.lit(None).cast("string").alias("signer"), args.alias("args"))


SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
#: Position and the asset of each event; ``v`` and others are what the maps above hold.
AUDIT = f"""e AS (SELECT event_id, event_type, user_id % 10 AS a, {SEC} // 3600 AS block, {SEC} // 600 % 6 AS tx, event_id AS log,
CASE WHEN event_id % 3 = 0 THEN {H('0', 40)} ELSE {H('event_id % 30 + 1', 40)} END AS f, CASE WHEN event_id % 4 = 0 THEN {H('0', 40)} ELSE {H('event_id % 50 + 1', 40)} END AS t, CASE WHEN event_id % 13 <> 0 THEN event_id END AS v FROM events)"""
ZERO = "'0x" + "0" * 40 + "'"
GATES = """c AS (SELECT a, block, tx, log, event_id % 2 <> 0 AS state, lag(event_id % 2 <> 0) OVER (PARTITION BY a ORDER BY block, tx, log) AS was FROM e WHERE event_type = 'click'),
g AS (SELECT a, state, block, tx, log, lead(block) OVER w AS to_block, lead(tx) OVER w AS to_tx, lead(log) OVER w AS to_log FROM c WHERE was IS NULL OR was <> state WINDOW w AS (PARTITION BY a ORDER BY block, tx, log))"""
