"""Aggregations of the explorer: block points, rates, histograms, address statistics, balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.functions import u256
from slotline.functions.hexabi import effective_from, histogram_bucket, holder_share


def block_points(blocks: DataFrame, txs: DataFrame, block: str, ts: str, oracle: Column, tx_block: str) -> DataFrame:
    """Transactions of each block, all and without keepers; empty blocks count 0."""
    counted = txs.groupBy(F.col(tx_block).alias("_b")).agg(F.count("*").alias("total"), F.count_if(~oracle).alias("app"))
    return blocks.join(counted, F.col(block) == F.col("_b"), "left").select(F.col(block).alias("block"), F.col(ts).alias("ts"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("app", F.lit(0)).alias("app"))


def block_histogram(points: DataFrame, n: str = "total") -> DataFrame:
    return points.groupBy(histogram_bucket(F.col(n)).alias("bucket")).agg(F.count("*").alias("blocks"))


def timeseries(points: DataFrame, ts: str, seconds: int, n: str = "total") -> DataFrame:
    bucket = (F.floor(F.col(ts) / seconds) * seconds).cast("bigint")
    return points.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("blocks"), F.sum(n).alias("txs"))


def cadence(points: DataFrame, slot: str, ts: str, n: str = "total") -> DataFrame:
    return points.agg(F.count_if(F.col(n) > 0).alias("filled"), F.count("*").alias("blocks"), (F.max(slot) - F.min(slot)).alias("slot_span"), (F.max(ts) - F.min(ts)).alias("time_span"))


def top_blocks(txs: DataFrame, block: str, k: int) -> DataFrame:
    return txs.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("txs")).orderBy(F.desc("txs"), F.desc("block")).limit(k)


def current_rate(txs: DataFrame, ts: str, oracle: Column, window: int) -> DataFrame:
    """All and keeper-free rate over the last ``window`` seconds before the latest row."""
    tip = txs.agg(F.max(ts).alias("_tip"))
    own = txs.join(F.broadcast(tip)).where(F.col(ts) > F.col("_tip") - window)  # one row
    return own.agg((F.count("*") / window).alias("tps"), (F.count_if(~oracle) / window).alias("app_tps"))


def block_list(blocks: DataFrame, txs: DataFrame, block: str, kind: str, kinds: list[str], gas: str) -> DataFrame:
    counts = txs.groupBy(block).agg(F.count("*").alias("txs"), F.sum(gas).alias("gas"), F.struct(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds]).alias("kinds"))
    return blocks.join(counts, block, "left")


def address_stats(txs: DataFrame, key: str, at: str, legs: list[str]) -> DataFrame:
    """Distinct transactions of each address over all legs, first and last seen; a transaction counts once an address."""
    arms = F.array_distinct(F.array(*[F.col(c) for c in legs]))
    touched = txs.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.explode(arms).alias("address")).where("address IS NOT NULL")
    return touched.groupBy("address").agg(F.count_distinct("_key").alias("txs"), F.min("_at").alias("first_seen"), F.max("_at").alias("last_seen"))


def token_balances(transfers: DataFrame, token: str, sender: str, receiver: str, amount: str, zero: str) -> DataFrame:
    """Exact balances: the zero address and balances of exactly 0 are out, negatives stay. A transfer is read once and gives
    both legs; limbs are summed before the one carry a holder."""
    sides = F.array(F.struct(F.col(sender).alias("holder"), F.lit(True).alias("out")), F.struct(F.col(receiver).alias("holder"), F.lit(False).alias("out")))
    legs = transfers.select(F.col(token).alias("token"), F.col(amount).alias("u"), F.explode(sides).alias("x")).select("token", "x.holder", "x.out", "u").where(F.col("holder") != zero)
    summed = legs.groupBy("token", "holder").agg(u256.signed_sum_of(F.col("u"), F.col("out")).alias("u"))
    carried = summed.select("token", "holder", F.explode(F.array(u256.normalise(F.col("u")))).alias("balance"))  # a generator, so the carry is computed once
    return carried.where(u256.sign(F.col("balance")) != 0)


def holder_counts(balances: DataFrame) -> DataFrame:
    return balances.where(u256.sign(F.col("balance")) > 0).groupBy("token").agg(F.count("*").alias("holders"))


def circulating_supply(balances: DataFrame, tokens: DataFrame, wrapper: Column) -> DataFrame:
    own = balances.where(u256.sign(F.col("balance")) > 0).groupBy("token").agg(u256.normalise(u256.sum_of(F.col("balance"))).alias("supply"))
    return tokens.join(own, "token", "left").withColumn("supply", F.when(wrapper, F.col("supply")))


def holders_page(balances: DataFrame, limit: int) -> DataFrame:
    """Largest holders of each token (balances as limbs) with rank and share of the token's positive total; the total is
    summed before the join. Shares are doubles made of the limbs. Ranking cuts each partition's rows before the shuffle is
    sorted, so a hot token sends its heads only where Spark's group limit applies."""
    totals = balances.where(u256.sign(F.col("balance")) > 0).groupBy("token").agg(u256.normalise(u256.sum_of(F.col("balance"))).alias("_total"))
    best = W.partitionBy("token").orderBy(F.desc(u256.order_key(F.col("balance"))), "holder")
    ranked = balances.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    both = ranked.join(totals, "token", "left")
    return both.withColumn("share", holder_share(u256.to_double(F.col("balance")), u256.to_double(F.col("_total")))).drop("_total")


def stats_overview(blocks: DataFrame, txs: DataFrame, addresses: DataFrame, tokens: DataFrame, cursors: DataFrame, now: Column, window: int = 60) -> DataFrame:
    """The dashboard's one row: latest block and slot, source tip (null while no cursor has reported one), all transactions,
    recent rate, addresses, contracts, synthetics, plain accounts (the residual, 0 at least), tokens by kind.

    blocks: block, slot, ts; txs: ts, origination, solana_signer, from_addr, from_address; addresses: address, is_contract;
    tokens: kind; cursors: table_name, source_max_slot. One scan a table, one-row sides joined."""
    sender = F.when((F.col("origination") != "ecdsa") & F.col("solana_signer").isNotNull(), effective_from(F.col("from_addr"), F.col("from_address")))
    sides = (
        blocks.agg(F.coalesce(F.max("block"), F.lit(0)).alias("latest_block"), F.coalesce(F.max("slot"), F.lit(0)).alias("latest_slot")),
        cursors.where("table_name = 'eth_block'").agg(F.max("source_max_slot").alias("source_max_slot")),
        txs.agg(F.count("*").alias("txs"), (F.count_if(F.col("ts") > now - window) / window).alias("tps"), F.count_distinct(sender).alias("synthetics")),
        addresses.agg(F.count("*").alias("addresses"), F.count_if(F.coalesce("is_contract", F.lit(False))).alias("contracts")),
        tokens.agg(F.count("*").alias("tokens"), *[F.count_if(F.coalesce(F.col("kind") == k, F.lit(False))).alias(n) for n, k in (("erc20", "ERC-20"), ("spl", "SPL"), ("token2022", "Token-2022"))]),
    )
    out = sides[0]
    for one in sides[1:]:
        out = out.join(F.broadcast(one))  # one row each
    return out.withColumn("plain", F.greatest(F.lit(0), F.col("addresses") - F.col("contracts") - F.col("synthetics")))


def slot_range_for_blocks(blocks: DataFrame, first: int, last: int, block: str = "block", slot: str = "slot") -> DataFrame:
    """Least and greatest slot of the blocks in [first, last]; nulls if there are none."""
    return blocks.where(F.col(block).between(first, last)).agg(F.min(slot).alias("from_slot"), F.max(slot).alias("to_slot"))


def finalized_tip(slots: DataFrame, slot: str = "slot", status: str = "status") -> DataFrame:
    """Greatest finalized slot; null if there is none."""
    return slots.agg(F.max(F.when(F.col(status) == "Finalized", F.col(slot))).alias("tip"))


def event_counts(events: DataFrame, columns: list[str]) -> DataFrame:
    return events.groupBy(*columns).agg(F.count("*").alias("n"))


def slot_digest(txs: DataFrame, slot: str, block_hash: str, idx: str) -> DataFrame:
    """Block hashes of each slot and transactions of each block index, as ordered values that two looks can compare."""
    per = txs.groupBy(slot, idx).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(block_hash)).alias("h"))
    return per.groupBy(slot).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h")))).alias("hashes"), F.array_sort(F.collect_list(F.struct(F.col(idx).alias("idx"), "n"))).alias("counts"))


def frontier(blocks: DataFrame, block: str, slot: str) -> DataFrame:
    return blocks.agg(F.max(block).alias("block_frontier"), F.min(block).alias("min_produced"), F.max_by(slot, block).alias("frontier_slot"), F.min_by(slot, block).alias("first_slot"))


def candidate_pairs(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()
