"""Pages: keyset, offset, with a total; the key bound is repeated on its first part so that it reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions.hexabi import CHAIN_PRECOMPILE, address_kind
from slotline.functions.registry import descriptors


def after(keys: list[str], last: list, descending: bool = True) -> Column:
    """Strictly beyond a key of one or more parts."""
    before = lambda c, v: F.col(c) < F.lit(v) if descending else F.col(c) > F.lit(v)
    arms = [reduce(lambda a, b: a & b, [*(F.col(k) == F.lit(v) for k, v in zip(keys[:n], last[:n])), before(keys[n], last[n])]) for n in range(len(keys))]
    first = F.col(keys[0]) <= F.lit(last[0]) if descending else F.col(keys[0]) >= F.lit(last[0])
    return first & reduce(lambda a, b: a | b, arms)


def keyset_page(df: DataFrame, keys: list[str], last: list | None, limit: int, descending: bool = True) -> DataFrame:
    """``limit`` rows beyond ``last`` and whether more follow."""
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    page = (df if last is None else df.where(after(keys, last, descending))).orderBy(*order).limit(limit + 1)
    n = page.agg(F.count("*").alias("_n"))
    return page.orderBy(*order).limit(limit).join(F.broadcast(n)).withColumn("has_more", F.col("_n") > limit).drop("_n")  # one row


def offset_page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, facets: dict[str, object], text: str | None, in_columns: list[str], order: list, offset: int, limit: int, member: tuple[str, object] | None = None) -> DataFrame:
    """Equality facets (None: any), array membership, a case-blind substring of any column; the total on each row."""
    for c, v in facets.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    if member is not None:
        df = df.where(F.array_contains(member[0], F.lit(member[1])))
    if text:
        df = df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lower(F.lit(text))) for c in in_columns]))
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


@dataclass(frozen=True)
class Listing:
    """A list that callers page through: order (descending), filter columns, values a filter may take, columns a text matches."""

    order: tuple[str, ...]
    filters: tuple[str, ...] = ()
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    members: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    hides_oracle: bool = False


ORIGINS = ("ecdsa", "solana_unsigned", "solana_ed25519")
SEAMS = ("evm_to_sol", "sol_to_evm", "bridge")
TOKEN_KINDS = ("ERC-20", "SPL", "Token-2022")
LISTS = {
    "blocks": Listing(("block",)),
    "txs": Listing(("slot_number", "tx_idx"), ("block", "sender", "origination"), {"origination": ORIGINS}, hides_oracle=True),
    "crossings": Listing(("slot_number", "tx_idx"), (), {"seams": SEAMS}, ("seams",), hides_oracle=True),
    "tokens": Listing(("address",), ("factory", "kind"), {"kind": TOKEN_KINDS}),
    "holders": Listing(("rank",), ("token",)),
    "transfers": Listing(("block", "log_index"), ("token",)),
    "gate_events": Listing(("slot_number", "log_index"), ("token",)),
    "addresses": Listing(("txs", "address"), ("kind",), {"kind": ("burn", CHAIN_PRECOMPILE, "precompile_eth", "token", "contract", "account", "eoa")}, text=("address", "label")),
    "address_tokens": Listing(("token",), ("holder",)),
    "meta_hooks": Listing(("slot_number", "sol_signature"), ("mint",)),
    "hooks": Listing(("calls", "hook")),
    "cross_chain": Listing(("block_number", "tx_hash"), ("tx_type",)),
    "audit_events": Listing(("block_number", "tx_index", "log_index"), ("event_name", "source_kind"), {"source_kind": tuple(dict.fromkeys(k for k, *_ in descriptors()))}),
}


def list_page(name: str, df: DataFrame, limit: int, last: list | None = None, text: str | None = None, with_oracle: bool = False, **filters: object) -> DataFrame:
    """A page of one of ``LISTS``: rows that match every filter given (a null never does), newest first, after ``last``.

    Keeper traffic is left out unless asked for, where the list knows it; a row that is not marked is no keeper's. A filter
    that the list does not have, or a value that it cannot take, is an error before any work."""
    own = LISTS[name]
    for c, v in filters.items():
        if c not in own.filters + own.members:
            raise ValueError(f"{name} has no filter {c}")
        if v is not None and c in own.values and v not in own.values[c]:
            raise ValueError(f"{c} cannot be {v}")
        if v is not None:
            df = df.where(F.array_contains(c, F.lit(v)) if c in own.members else F.col(c).eqNullSafe(F.lit(v)))
    if text:
        if not own.text:
            raise ValueError(f"{name} is not searched")
        df = df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lower(F.lit(text))) for c in own.text]))
    if own.hides_oracle and not with_oracle:
        df = df.where(~F.coalesce("is_oracle", F.lit(False)))
    return keyset_page(df, list(own.order), last, limit)


def detail(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a list that a key names; the filter reaches the scans below the list's plan."""
    return df.where(F.col(key) == F.lit(value))


def block_detail(blocks: DataFrame, number: int | None = None, block_hash: str | None = None) -> DataFrame:
    """A block of ``aggs.block_list`` by its number or hash."""
    return detail(blocks, "block", number) if number is not None else detail(blocks, "block_hash", block_hash.lower())


def token_detail(tokens: DataFrame, counts: DataFrame, supplies: DataFrame, address: str) -> DataFrame:
    """A token with its holder count (0 if nobody holds it) and, for wrappers, its supply."""
    own = detail(tokens, "token", address.lower()).join(counts, "token", "left").join(supplies.select("token", "supply"), "token", "left")
    return own.withColumn("holders", F.coalesce("holders", F.lit(0)))


def hook_detail(invocations: DataFrame, executions: DataFrame, signature: str) -> DataFrame:
    """A router invocation with its hooks in order."""
    runs = executions.groupBy("sol_signature").agg(F.array_sort(F.collect_list(F.struct("idx", "hook_address", "result"))).alias("hooks"))
    return detail(invocations, "sol_signature", signature).join(runs, "sol_signature", "left")


def trace_detail(traces: DataFrame, tx_hash: str) -> DataFrame:
    return detail(traces, "tx_hash", tx_hash.lower())


def block_positions(feed: DataFrame, block: int | None = None, block_hash: str | None = None, index: int | None = None) -> DataFrame:
    """Transactions of a block, by number or hash, in order of their index; the one at ``index`` if given."""
    own = detail(feed, "block", block) if block is not None else detail(feed, "block_hash", block_hash.lower())
    return (own if index is None else own.where(F.col("tx_index") == index)).orderBy("tx_index")


def block_tx_count(feed: DataFrame, block: int | None = None, block_hash: str | None = None) -> DataFrame:
    return block_positions(feed, block, block_hash).agg(F.count("*").alias("txs"))


def block_receipts(feed: DataFrame, results: DataFrame, block: int | None = None, block_hash: str | None = None) -> DataFrame:
    """Receipts of all transactions of a block; one without a result has a null receipt."""
    return block_positions(feed, block, block_hash).join(results.select("tx_hash", "receipt_params"), "tx_hash", "left").orderBy("tx_index")


def address_detail(addresses: DataFrame, stats: DataFrame, labels: DataFrame, owners: DataFrame, tokens: DataFrame, creators: DataFrame | None = None, key: str = "address") -> DataFrame:
    """Addresses with statistics (0 and null by default), label, creator, controlling signer, token flag and kind."""
    out = addresses.join(stats, key, "left").join(labels, key, "left").join(owners, key, "left").join(tokens.select(key).distinct().withColumn("is_token", F.lit(True)), key, "left")
    if creators is not None:
        out = out.join(creators, key, "left")
    return out.withColumns({"txs": F.coalesce("txs", F.lit(0)), "is_token": F.coalesce("is_token", F.lit(False))}).withColumn("kind", address_kind(F.col(key), F.col("is_token"), F.coalesce("has_code", F.lit(False)), F.col("owner").isNotNull()))


def ordered_legs(legs: DataFrame) -> DataFrame:
    return legs.orderBy("slot_number", "tx_idx", "instr_idx")
