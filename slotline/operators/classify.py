"""Classification: action tags, seams, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions.hexabi import CPI, DEPOSIT_TAG, HELPER, SYSTEM, WITHDRAW, chain, is_oracle, legs_build, method_name

#: Event topics and the method names of each action.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
APPROVAL = "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
SWAPS = ("0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822", "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67")
MULTI_TRANSFERS = ("0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62", "0x4a39dc06d4c0dbc64b50af37ef0f9d05e9bbb56eb8b8c037d8c5e88c5f2e7f6f")
PAIR_MINT = "0x4c209b5fc8ad50758f13e2e1088ba56a560dff690a1c6fef26394f4c03821c4f"
PAIR_BURN = "0xdccd412f0b1252819cb1fd330b93224ca42612892bb3f4f789976e6d81936496"
ZERO_TOPIC = "0x" + "0" * 64
DEPOSIT_TYPE = 0x7E
METHOD_ACTIONS = {
    "oracle_refresh": ("refresh", "refreshAll"),
    "lend_supply": ("supply", "supplyTo", "supplyFrom"),
    "lend_withdraw": ("withdrawTo", "withdrawFrom"),
    "lend_borrow": ("borrow",),
    "lend_repay": ("repay", "repayWithATokens"),
    "liquidate": ("liquidationCall", "absorb", "buyCollateral"),
    "bridge_out": ("bridgeOutToSolana",),
    "faucet_claim": ("claimTokens", "drip", "faucet"),
    "multicall": ("aggregate", "aggregate3", "aggregate3Value", "tryAggregate", "tryBlockAndAggregate"),
    "account_activate": ("activate",),
    "collect_fees": ("collect",),
    "add_liquidity": ("increaseLiquidity",),
    "remove_liquidity": ("decreaseLiquidity",),
}


def tag(test: Column, name: str) -> Column:
    return F.when(test, F.lit(name))


def is_contract_creation(to: Column, input_len: Column) -> Column:
    return F.coalesce(to, F.lit("")).eqNullSafe("") & F.coalesce(input_len > 0, F.lit(False))


def call_tags(tx_type: Column, method: Column, to: Column, value_wei: Column, type_byte: Column, legs: Column, input_len: Column) -> tuple[Column, Column]:
    """What the call itself says: the first test that holds decides the first tags, the method's name the others (may be null)."""
    method = F.coalesce(method, F.lit(""))
    plain = method.isin("0x", "", "(method)")
    valued = F.coalesce(value_wei.rlike("[^0]"), F.lit(False))
    to = F.lower(F.coalesce(to, F.lit("")))
    both = F.coalesce(legs, F.lit(0)) >= 2
    romulus = F.coalesce(tx_type == "Romulus", F.lit(False))
    one = lambda *names: F.array(*[F.lit(n) for n in names])
    primary = chain(
        [
            (is_contract_creation(to, input_len), one("contract_creation")),
            (F.coalesce(type_byte == DEPOSIT_TYPE, F.lit(False)) & plain, one(DEPOSIT_TAG)),
            (romulus & plain & both & ~valued, one("solana_only")),
            (to == CPI, one("solana_cpi")),
            (to == SYSTEM, one("system_call")),
            ((to == HELPER) & (method == "deposit_from_ata(uint256)"), one("unwrap", "helper_call")),
            (to == HELPER, one("helper_call")),
            ((to == WITHDRAW) & method.isin("withdraw_to_ata(uint256)", "withdraw_to_pda(uint256)"), one("wrap", "withdraw_precompile")),
            (to == WITHDRAW, one("withdraw_precompile")),
            (romulus & ~plain & both, one("cross_chain_call")),
        ],
        F.array().cast("array<string>"),
    )
    name = method_name(method)
    by_name = F.array(chain([(name.isin(*names), action) for action, names in METHOD_ACTIONS.items()], F.lit(None).cast("string")), tag(method.isin("withdraw(address,uint256)", "withdraw(address,uint256,address)"), "lend_withdraw"))
    return primary, by_name


def action_tags(tx_type: Column, method: Column, to: Column, value_wei: Column, type_byte: Column, legs: Column, logs: Column, input_len: Column, firsts: Column | None = None) -> Column:
    """Ordered, distinct tags. ``logs``: array of structs with ``topics``; ``firsts``: their first topics in lower case, where
    the caller has them."""
    primary, by_name = call_tags(tx_type, method, to, value_wei, type_byte, legs, input_len)
    method = F.coalesce(method, F.lit(""))
    plain = method.isin("0x", "", "(method)")
    valued = F.coalesce(value_wei.rlike("[^0]"), F.lit(False))
    logs = F.coalesce(logs, F.array().cast("array<struct<topics:array<string>>>"))
    topic = lambda log, k: F.lower(F.coalesce(F.get(log["topics"], F.lit(k)), F.lit("")))
    firsts = F.transform(logs, lambda log: topic(log, 0)) if firsts is None else firsts
    seen = lambda *wanted: F.arrays_overlap(firsts, F.array(*[F.lit(x) for x in wanted]))
    pools = F.array(tag(seen(*SWAPS), "swap"), tag(seen(PAIR_MINT), "add_liquidity"), tag(seen(PAIR_BURN), "remove_liquidity"), chain([((method == "deposit()") & valued, "wrap"), (method == "withdraw(uint256)", "unwrap")], F.lit(None).cast("string")))
    moved = F.transform(
        F.filter(logs, lambda log: topic(log, 0) == TRANSFER),
        lambda log: F.concat(F.when(F.size(log["topics"]) == 4, "nft_").otherwise("token_"), F.when(topic(log, 1) == ZERO_TOPIC, "mint").when(topic(log, 2) == ZERO_TOPIC, "burn").otherwise("transfer")),
    )
    rest = F.array(tag(seen(*MULTI_TRANSFERS), "nft_transfer"), tag(seen(APPROVAL) | method.isin("approve(address,uint256)", "setApprovalForAll(address,bool)"), "token_approval"))
    tags = F.array_distinct(F.filter(F.concat(primary, by_name, pools, moved, rest), lambda t: t.isNotNull()))
    fallback = F.array(F.when(valued & plain, "coin_transfer").when(~plain, "contract_call").otherwise("empty_call"))
    return F.when(F.size(tags) > 0, tags).otherwise(fallback)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A computed column that later steps read; as a generator's output it is not written into each of them again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def tagged(feed: DataFrame) -> DataFrame:
    """A feed (tx_type, method, to_addr, value_wei, tx_type_byte, leg_count, logs, input_len) with ``tags``, computed once a row."""
    first = once(feed, "_firsts", F.transform(F.coalesce("logs", F.array().cast("array<struct<topics:array<string>>>")), lambda log: F.lower(F.coalesce(F.get(log["topics"], F.lit(0)), F.lit("")))))
    tags = action_tags(F.col("tx_type"), F.col("method"), F.col("to_addr"), F.col("value_wei"), F.col("tx_type_byte"), F.col("leg_count"), F.col("logs"), F.col("input_len"), F.col("_firsts"))
    return once(first, "tags", tags).drop("_firsts")


def crossings(feed: DataFrame, keys: list[str]) -> DataFrame:
    """Transactions that join two sides: ``keys``, seams, and whether they are keeper traffic. The feed is ``tagged``'s with
    origination, solana_signer, has_cpi_target and method_id. No tag that logs give makes a seam, so logs are not read."""
    by_solana = (F.coalesce("origination", F.lit("ecdsa")) != "ecdsa") & F.col("solana_signer").isNotNull()
    tags = F.concat(*call_tags(*map(F.col, ("tx_type", "method", "to_addr", "value_wei", "tx_type_byte", "leg_count", "input_len"))))
    told = once(feed, "_told", F.filter(tags, lambda t: t.isNotNull()))
    own = once(told, "seams", seams(F.col("_told"), F.col("to_addr"), F.col("tx_type"), F.col("origination"), F.col("tx_type_byte"), F.col("has_cpi_target"), by_solana))
    return own.where(F.size("seams") > 0).select(*keys, "seams", is_oracle(F.col("method_id")).alias("is_oracle"))


def seams(tags: Column, to: Column, tx_type: Column, origination: Column, type_byte: Column, has_target: Column, by_solana: Column) -> Column:
    """Sides that a transaction joins: evm_to_sol, sol_to_evm, bridge, in this order."""
    has = lambda *names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = yes(has("solana_cpi", "cross_chain_call")) | yes(F.lower(to) == CPI) | yes(tx_type == "Romulus") | yes(has_target)
    into = yes(origination.isin("solana_unsigned", "solana_ed25519")) | yes(by_solana)
    bridge = yes(has("bridge_out", "bridge_in", "withdraw_precompile", DEPOSIT_TAG)) | yes(type_byte == DEPOSIT_TYPE)
    return F.filter(F.array(tag(out, "evm_to_sol"), tag(into, "sol_to_evm"), tag(bridge, "bridge")), lambda s: s.isNotNull())


def tx_type(top_level: Column, infra: Column, origination: Column) -> tuple[Column, Column]:
    """Romulus if signed and a top-level program is no infrastructure; and those programs, sorted."""
    own = F.array_sort(F.array_distinct(F.array_except(top_level, infra)))
    signed = origination != "solana_unsigned"
    return F.when(signed & (F.size(own) > 0), "Romulus").otherwise("Rhea"), F.when(signed, own).otherwise(F.array().cast("array<string>"))


def is_informative(tx_type: Column, legs: Column, target: Column) -> Column:
    """Whether a correlation says more than the defaults: another type than Rhea, a leg, or a call target."""
    return (tx_type != "Rhea") | (F.coalesce(F.size(legs), F.lit(0)) > 0) | target.isNotNull()


def correlations(txs: DataFrame, signatures: DataFrame, programs: DataFrame, targets: DataFrame, infra: list[str], cluster: str) -> DataFrame:
    """One row for each transaction that says more than the defaults: type, flipping programs, EVM leg, native legs (Romulus
    only), call target.

    txs: chain_id, tx_hash, block_number, origination (null: ecdsa); signatures: chain_id, tx_hash, signature; programs:
    signature and its top-level programs; targets: signature, program, instruction. A transaction without signatures, or with
    one whose lines are not there yet, waits. Of several signatures' targets the least signature's counts."""
    keys = ["chain_id", "tx_hash"]
    sides = signatures.join(programs, "signature", "left").join(targets.select("signature", F.struct("program", "instruction").alias("target")), "signature", "left")
    grouped = sides.groupBy(*keys).agg(
        F.array_sort(F.collect_set("signature")).alias("signatures"),
        F.array_distinct(F.flatten(F.collect_list("programs"))).alias("top_level"),
        F.count_if(F.col("programs").isNull()).alias("unread"),
        F.min_by("target", F.when(F.col("target").isNotNull(), F.col("signature"))).alias("target"),
    )
    read = txs.join(grouped.where("unread = 0"), keys)
    kind, flipping = tx_type(F.col("top_level"), F.array(*[F.lit(x) for x in infra]), F.coalesce("origination", F.lit("ecdsa")))
    made = read.select(
        *keys, kind.alias("tx_type"), flipping.alias("flipping"), "block_number", "target",
        F.array(F.struct(F.col("chain_id").alias("chainId"), F.col("block_number").alias("blockNumber"), F.col("tx_hash").alias("txHash"))).alias("evm_legs"), "signatures",
    )
    legs = made.withColumn("solana_legs", legs_build(F.col("signatures"), F.lit(cluster), F.col("tx_type")))
    out = legs.where(is_informative(F.col("tx_type"), F.col("solana_legs"), F.col("target")))
    return out.select(*keys, "tx_type", "flipping", "evm_legs", "solana_legs", F.coalesce("block_number", F.lit(0)).alias("block_number"), F.col("target.program").alias("cpi_program"), F.col("target.instruction").alias("cpi_instruction"))


def verify_outcome(status: Column, name: Column) -> Column:
    return F.when((status == 200) & name.isNotNull(), "verified").when((status == 404) | ((status == 200) & name.isNull()), "not_verified").otherwise("transient")
