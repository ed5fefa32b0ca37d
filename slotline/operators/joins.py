"""Joins: feeds, attachments, semi and anti joins, range and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.sources.io import scratch

from . import scan


def tx_feed(block_txs: DataFrame, txs: DataFrame, results: DataFrame, blocks: DataFrame, methods: DataFrame, correlations: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each mined transaction: its block and body (inner), result, method, type and class (left)."""
    return (
        block_txs.join(blocks, ["chain_id", "slot_number", "slot_block_idx"])
        .join(txs, ["chain_id", "tx_hash"])
        .join(results, ["chain_id", "tx_hash"], "left")
        .join(methods, "method_id", "left")
        .join(correlations, ["chain_id", "tx_hash"], "left")
        .join(classes, ["chain_id", "tx_hash"], "left")
        .withColumns({"method": F.coalesce("signature", "method_id", F.lit("0x")), "tx_type": F.coalesce("tx_type", F.lit("Rhea")), "sender": F.coalesce("from_addr", "from_address")})
    )


def tx_detail(feed: DataFrame, signatures: DataFrame, transfers: DataFrame, executions: DataFrame, registry: DataFrame) -> DataFrame:
    """Feed rows with their least signature, their transfers and their hooks, each side aggregated before its join."""
    first = signatures.groupBy("chain_id", "tx_hash").agg(F.min("signature").alias("first_signature"))
    moved = attach_list(feed.join(first, ["chain_id", "tx_hash"], "left"), transfers, ["chain_id", "tx_hash"], [c for c in ("log_index", "token", "sender", "receiver", "amount") if c in transfers.columns], "transfers")
    return attach_hooks(moved, executions, registry)


def attach_first(rows: DataFrame, side: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """LATERAL ... LIMIT 1: the side's value of least order, aggregated before the join."""
    return rows.join(side.groupBy(*keys).agg(F.min_by(value, order).alias(name)), keys, "left")


lateral_first = attach_first


def attach_list(rows: DataFrame, side: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """The side's rows of each key as a sorted array of structs."""
    return rows.join(side.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.array().cast(_list_type(side, columns))))


def _list_type(side: DataFrame, columns: list[str]) -> str:
    return f"array<{side.select(F.struct(*columns).alias('x')).schema['x'].dataType.simpleString()}>"


def attach_hooks(txs: DataFrame, executions: DataFrame, registry: DataFrame) -> DataFrame:
    """Hook executions of each transaction; a hook with many registrations takes its least name."""
    names = registry.groupBy("hook").agg(F.min("name").alias("hook_name"))
    return attach_list(txs, executions.join(names, "hook", "left"), ["tx_hash"], ["idx", "hook", "hook_name", "result"], "hooks")


def touching(rows: DataFrame, columns: list[str], value, order: list, limit: int) -> DataFrame:
    """Rows that hold ``value`` in any of the columns: a union of keyed look-ups, each cut to the page, before decoration."""
    out = None
    for c in columns:
        one = rows.where(F.col(c) == F.lit(value)).orderBy(*order).limit(limit)
        out = one if out is None else out.unionByName(one)
    return out.distinct().orderBy(*order).limit(limit)


def anti_no_trace(txs: DataFrame, traces: DataFrame) -> DataFrame:
    """Transactions without a trace row."""
    return txs.join(traces.select("chain_id", "tx_hash"), ["chain_id", "tx_hash"], "left_anti")


def anti(rows: DataFrame, known: DataFrame, keys: list[str], fresh: Column | None = None) -> DataFrame:
    """Distinct keys with no known row, or with none that is fresh."""
    have = known if fresh is None else known.where(fresh)
    return rows.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def semi_signal(rows: DataFrame, key: str, *signals: DataFrame) -> DataFrame:
    """Rows whose key appears in any signal: the OR of EXISTS as one semi join."""
    keys = None
    for s in signals:
        own = s.toDF(key)
        keys = own if keys is None else keys.unionByName(own)
    return rows.join(keys, key, "left_semi")


def synthetic_owner(txs: DataFrame) -> DataFrame:
    sender = F.lower(F.coalesce("from_addr", "from_address"))
    own = txs.where((F.col("origination") != "ecdsa") & F.col("solana_signer").isNotNull())
    return own.groupBy(sender.alias("address")).agg(F.min("solana_signer").alias("owner"))


def creators(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Created contracts with their creator; the first receipt of an address is kept."""
    new = txs.where(F.coalesce("to_addr", F.lit("")).eqNullSafe("") & (F.col("input_len") > 0))
    made = new.join(receipts, "tx_hash").select(F.lower("contract_address").alias("address"), F.lower(F.coalesce("receipt_from", "from_addr", "from_address")).alias("creator"), "block_number")
    return made.groupBy("address").agg(F.min_by("creator", "block_number").alias("creator"))


def in_interval(events: DataFrame, spans: DataFrame, keys: list[str], position: str, lo: str = "from_pos", hi: str = "to_pos", closed: bool = False, how: str = "inner") -> DataFrame:
    """Range join on equal keys and a half-open interval (null end: open); ``closed``: both ends in."""
    s = spans.alias("s")
    upper = (F.col(position) <= F.col(f"s.{hi}")) if closed else (F.col(position) < F.col(f"s.{hi}"))
    on = (F.col(position) >= F.col(f"s.{lo}")) & (F.col(f"s.{hi}").isNull() | upper)
    for k in keys:
        on &= events[k] == F.col(f"s.{k}")
    extra = [F.col(f"s.{c}") for c in spans.columns if c not in keys]
    return events.join(s, on, how).select(*[events[c] for c in events.columns], *extra) if how != "left_semi" else events.join(s, on, how)


def as_of(points: DataFrame, states: DataFrame, keys: list[str], position: str, value: str, default=None, bits: int | None = scan.BITS) -> DataFrame:
    """The state in force at each point: points and changes in one order, last change carried forward; a change at the
    point's own position counts. A key's order is cut into segments of 2**bits positions, each seeded with the last change
    before it; None keeps a key in one task."""
    cols = [c for c in points.columns if c not in (*keys, position)]
    kind = states.schema[value].dataType.simpleString()
    left = points.select(*keys, F.col(position).alias("_pos"), F.struct(*cols).alias("_point"), F.lit(1).alias("_kind"), F.lit(None).cast(f"struct<v:{kind}>").alias("_state"))
    right = states.select(*keys, F.col("from_pos").alias("_pos"), F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), F.lit(0).alias("_kind"), F.struct(F.col(value).alias("v")).alias("_state"))
    both = left.unionByName(right)
    rows = scan.carried_last(both.withColumn("_seg", scan.segment(both, "_pos", bits)), keys, ["_pos"], "_state")
    w = scan.sequence(keys, "_pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("_state", ignorenulls=True).over(w)["v"]
    return rows.withColumn("_now", last).where("_kind = 1").select(*keys, F.col("_pos").alias(position), "_point.*", F.coalesce("_now", F.lit(default)).alias(value))


def fits_filter(kind: Column | None = None, values: Column | None = None) -> Column:
    """Whether an event (sender, receiver, id) passes filter_kind and filter_values: none, from, touch, or ids (an event
    without id passes)."""
    kind, values = F.col("filter_kind") if kind is None else kind, F.col("filter_values") if values is None else values
    held = lambda c: F.coalesce(F.array_contains(values, F.col(c)), F.lit(False))
    return F.when(kind == "none", True).when(kind == "from", held("sender")).when(kind == "touch", held("sender") | held("receiver")).otherwise(F.col("id").isNull() | held("id"))


def asset_events(events: DataFrame, spans: DataFrame, key: str = "event_id", width: int = 10_000) -> DataFrame:
    """(asset_id, event) of each event in a span of its source: half-open block range on the address, and the span's filter.
    An event counts once an asset, by its key. Spans of one asset, address and filter that overlap are joined first, so an
    event meets each filter of its address once, not every span that holds it. A span is dealt to the ranges of ``width`` blocks that it meets, so a join key
    is an address and a range, never an address's whole history; an open span ends at the last event."""
    # values don't matter where all events pass
    asked = spans.withColumn("filter_values", F.when(F.col("filter_kind") == "none", F.array().cast(spans.schema["filter_values"].dataType)).otherwise(F.coalesce("filter_values", F.array().cast(spans.schema["filter_values"].dataType))))
    held = scan.union_of(asked.withColumn("filter_kind", F.coalesce("filter_kind", F.lit(""))), ["asset_id", "address", "filter_kind", "filter_values"], "from_block", "to_block")
    last = events.agg(F.max("block").alias("_last"))
    end = F.coalesce(F.col("to_block") - 1, F.col("_last"))
    dealt = held.join(F.broadcast(last)).where(end >= F.col("from_block")).withColumn("_range", F.explode(F.sequence(F.floor(F.col("from_block") / width), F.floor(end / width)))).drop("_last")  # one row
    own = events.withColumn("_range", F.floor(F.col("block") / width))
    met = own.join(dealt.withColumnRenamed("address", "_address"), (own["address"] == F.col("_address")) & (own["_range"] == dealt["_range"])).where((F.col("block") >= F.col("from_block")) & (F.col("to_block").isNull() | (F.col("block") < F.col("to_block"))) & fits_filter())
    return met.select("asset_id", *(own[c] for c in events.columns)).dropDuplicates(["asset_id", key])


def filter_union(events: DataFrame, filters: DataFrame, key: str = "event_id") -> DataFrame:
    """Events that any filter of their address lets through; once each, by their key. An address's filters are one row."""
    held = filters.groupBy(F.col("address").alias("_address")).agg(F.collect_set(F.struct("filter_kind", "filter_values")).alias("_filters"))
    met = events.join(held, events["address"] == F.col("_address"))
    return met.where(F.exists("_filters", lambda f: fits_filter(f["filter_kind"], f["filter_values"]))).select(*events.columns).dropDuplicates([key])


def registry_observed(registry: DataFrame, executions: DataFrame, keys: list[str]) -> DataFrame:
    return executions.select(*keys).distinct().join(registry, keys, "left_anti")


def role_open_at(points: DataFrame, roles: DataFrame, block: str = "block", bits: int = scan.BITS) -> DataFrame:
    """Roles that an account (source, account) holds at a block; both ends count. roles: source, account, role, from_block,
    to_block (null: open). One sweep over each range of 2**bits blocks, so an account with many roles makes no pairs that don't
    match. Equal roles are met as one and repeated in place: their rows stand together, which is all that a file has to tell."""
    own = ["source", "account", "role", "from_block", "to_block"]
    held = roles.groupBy(*own).agg(F.count("*").cast("int").alias("_copies"))
    met = scan.sweep_join(points, held, ["source", "account"], block, "from_block", "to_block", closed=True, bits=bits)
    return met.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("_copies")))).select(*points.columns, "role", "from_block", "to_block")


def signer_attribution(changes: DataFrame, sources: DataFrame, roles: DataFrame, multisig: str | None, key: list[str]) -> DataFrame:
    """signed_by of each change: UNKNOWN without a signer, MULTISIG, ISSUER_KEY if the signer holds any role that is open at
    that block on any source of the asset, else UNKNOWN.

    changes: ``key``, asset_id, block, signer; sources: asset_id, source; roles: source, account, role, from_block, to_block.
    Changes find their roles through (source, account) and come back by their key, so nulls in other columns don't matter. Any
    open role will do, so overlapping ones are joined first and a change looks up the last that began: no pairs are made."""
    asked = changes.where("signer IS NOT NULL").select(*key, "asset_id", "block", F.col("signer").alias("account")).join(sources.select("asset_id", "source").distinct(), "asset_id")
    spans = scan.union_of(roles, ["source", "account"], "from_block", "to_block", closed=True)
    begun = spans.select("source", "account", F.col("from_block").alias("from_pos"), F.struct(F.col("to_block").alias("end")).alias("span"))
    met = as_of(asked, begun, ["source", "account"], "block", "span").where(F.col("span").isNotNull() & (F.col("span.end").isNull() | (F.col("block") <= F.col("span.end"))))
    held = met.select(*key).distinct().withColumn("_holds", F.lit(True))
    signed = F.when(F.col("signer").isNull(), "UNKNOWN").when(F.col("signer") == F.lit(multisig), "MULTISIG").when(F.col("_holds"), "ISSUER_KEY").otherwise("UNKNOWN")
    return changes.join(held, key, "left").withColumn("signed_by", signed).drop("_holds")


def pair_closure(edges: DataFrame, holds: DataFrame, start: DataFrame, rounds: int = 16) -> DataFrame:
    """Addresses reached from ``start`` over transfers to pools that hold the token. Each round joins its frontier alone and
    adds it to one written table, which is all that later rounds read."""
    spark, path = edges.sparkSession, scratch(edges.sparkSession)
    shape = start.select("address").schema
    start.select("address").distinct().write.parquet(f"{path}/round=0")
    for k in range(1, rounds + 1):
        frontier = spark.read.schema(shape).parquet(f"{path}/round={k - 1}")
        seen = spark.read.parquet(path).select("address")
        step = edges.join(frontier.withColumnRenamed("address", "a"), "a").select(F.col("b").alias("address")).distinct()
        step.join(holds, "address", "left_semi").join(seen, "address", "left_anti").write.parquet(f"{path}/round={k}")
        if spark.read.schema(shape).parquet(f"{path}/round={k}").isEmpty():
            break
    return spark.read.parquet(path).select("address")
