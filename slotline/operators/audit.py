"""The audit's derived tables, all from one append-only event table and a configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.functions import u256
from slotline.functions.hexabi import ZERO_ADDRESS

from . import joins, seq
from .upkeep import config_check

AT = ["block", "tx", "log"]
#: Pieces that the markets of one asset are dealt to.
PIECES = 16


@dataclass
class Config:
    """What the rebuild looks at. assets: asset_id, token, module, router, factory, storefront (the last three may be null);
    blacklists, yield_tokens, purchase_tokens: asset_id, address; sanctions: address; routers: router."""

    assets: DataFrame
    blacklists: DataFrame
    yield_tokens: DataFrame
    purchase_tokens: DataFrame
    sanctions: DataFrame
    routers: DataFrame
    sanctions_type: str
    multisig: str | None = None


def arg(name: str) -> Column:
    return F.try_element_at("args", F.lit(name))


def amount(name: str) -> Column:
    return u256.from_hex(arg(name), bad_is_zero=False)


def of_assets(events: DataFrame, assets: DataFrame, column: str, *names: str) -> DataFrame:
    """Events of these names with the asset that has their source in ``column``."""
    own = assets.where(F.col(column).isNotNull()).select("asset_id", F.col(column).alias("source")).distinct()
    return events.where(F.col("event_name").isin(*names)).join(own, "source")


def rebuild_all(events: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The fourteen tables, by name. events: event_id, source, source_kind, event_name, block, tx, log, signer, args (a map of
    texts as ``decode_events`` gives them). Every table depends on the events' positions alone, never on their order of
    arrival, so two builds agree. An asset whose router is not configured is an error before any work."""
    assets = config.assets
    config_check(assets.where("router IS NOT NULL").select("router"), config.routers, "router")
    out: dict[str, DataFrame] = {}
    true = lambda name: F.when(arg(name).isNotNull(), arg(name) == "true")

    listed = of_assets(events, assets, "module", "WhitelistStatusChanged").withColumn("address", arg("account")).where("address IS NOT NULL")
    out["allowlist_interval"] = seq.member_intervals(listed, ["asset_id", "address"], AT, true("isWhitelisted"), F.col("address") == ZERO_ADDRESS)
    toggles = of_assets(events, assets, "module", "TransfersRestrictionToggled").where(arg("transfersAllowed").isNotNull())
    out["gate_interval"] = seq.state_intervals(toggles, ["asset_id"], AT, ~true("transfersAllowed"))
    denied = events.where(F.col("event_name").isin("Sanctioned", "Unsanctioned")).join(config.sanctions.select(F.col("address").alias("source")), "source", "left_semi").withColumn("address", arg("account")).where("address IS NOT NULL")
    out["sanction_denyset_interval"] = seq.member_intervals(denied, ["source", "address"], AT, F.col("event_name") == "Sanctioned")
    routed = events.join(config.routers.select(F.col("router").alias("source")), "source", "left_semi").select("source", *AT, "event_name", arg("typeId").alias("type_id"), true("isGlobal").alias("is_global"), F.coalesce(arg("globalImplementation"), arg("newGlobalImplementation")).alias("module"))
    epochs = seq.register_epochs(routed, ["source"], AT, config.sanctions_type).withColumnRenamed("source", "router")
    out["router_sanctions_epoch"] = epochs

    moved = of_assets(events, assets, "token", "Transfer").select("asset_id", "event_id", *AT, F.struct(*AT).alias("pos"), arg("from").alias("sender"), arg("to").alias("receiver"), amount("value").alias("value"))
    out["exposure_window"] = seq.exposure_windows(out["gate_interval"], moved.select("asset_id", "pos", "sender", "receiver"), out["allowlist_interval"].select("asset_id", "address"), ["asset_id"])
    barred = of_assets(events, config.blacklists, "address", "YieldBlacklistUpdated").withColumn("account", arg("account")).where("account IS NOT NULL")
    out["yield_blacklist_interval"] = seq.member_intervals(barred, ["asset_id", "account"], AT, true("isBlacklisted"), F.col("account") == ZERO_ADDRESS)

    screened = events.where("event_name = 'TransferScreened'").join(config.sanctions.select(F.col("address").alias("source")), "source", "left_semi")
    both = moved.select(*AT, "event_id", F.lit(False).alias("_open")).unionByName(screened.select(*AT, "event_id", F.lit(True).alias("_open")))
    pairs = seq.lifo_pair(both, ["block", "tx"], ["log"], F.col("_open"), ~F.col("_open"), "event_id", bits=None).select(F.col("close_id").alias("event_id"), "open_id")
    paired = moved.select("asset_id", "event_id", *AT, "pos").join(pairs, "event_id")
    out["transfer_screening"] = paired.where("open_id IS NOT NULL").join(screened.select(F.col("event_id").alias("open_id"), F.col("source").alias("module"), F.col("log").alias("screening_log")), "open_id").select("asset_id", *AT, F.col("event_id").alias("transfer_event"), F.col("open_id").alias("screening_event"), "screening_log", "module")
    bare = paired.where("open_id IS NULL").join(assets.select("asset_id", "router"), "asset_id")
    # a router's epochs never overlap, so the last one to begin decides
    spell = joins.as_of(bare, epochs.select("router", "from_pos", F.struct("module", "to_pos").alias("_spell")), ["router"], "pos", "_spell")
    inside = F.col("_spell").isNotNull() & (F.col("_spell.to_pos").isNull() | (F.col("pos") < F.col("_spell.to_pos")))
    out["screening_gap"] = spell.where(inside).select("asset_id", *AT, F.col("event_id").alias("transfer_event"), F.col("_spell.module").alias("epoch_module"))

    tokens = config.yield_tokens.select("asset_id", F.col("address").alias("yield_token")).distinct().join(assets.select("asset_id", "token"), "asset_id")
    credits = events.where("event_name = 'Transfer'").join(tokens, (F.col("source") == F.col("yield_token")) & (arg("from") == F.col("token"))).select("asset_id", "yield_token", *AT, F.lit(True).alias("_credit"), arg("to").alias("holder"), amount("value").alias("u"))
    closes = events.where("event_name = 'YieldDistributed'").join(tokens, (F.col("source") == F.col("token")) & (arg("token") == F.col("yield_token"))).select("asset_id", "yield_token", *AT, F.lit(False).alias("_credit"), F.lit(None).cast("string").alias("holder"), amount("amount").alias("u"))
    flow, key = credits.unionByName(closes), ["asset_id", "yield_token"]
    out["yield_run"] = seq.yield_runs(flow, key, AT, F.col("_credit"), ~F.col("_credit"), F.col("u"), F.col("u"), limbs=True)
    out["yield_credit"] = seq.yield_credits(flow, key, AT, F.col("_credit"), ~F.col("_credit"), F.col("holder"), F.col("u"))

    sides = [assets.select("asset_id", F.col(c).alias("source")) for c in ("token", "module", "router", "factory", "storefront")] + [config.blacklists.select("asset_id", F.col("address").alias("source"))]
    sources = sides[0]
    for s in sides[1:]:
        sources = sources.unionByName(s)
    sources = sources.where("source IS NOT NULL").distinct()
    granted = events.where(F.col("event_name").isin("RoleGranted", "RoleRevoked")).join(sources.select("source").distinct(), "source", "left_semi").select("source", *AT, "event_name", arg("role").alias("role"), arg("account").alias("account")).where("role IS NOT NULL AND account IS NOT NULL")
    roles = seq.member_intervals(granted, ["source", "role", "account"], AT, F.col("event_name") == "RoleGranted")
    out["role_interval"] = roles

    changes = seq.code_changes(events, AT)
    homes = [("token", ("UPGRADE", "MODULE_SET", "MODULE_LINKED")), ("router", ("ROUTER_GLOBAL",)), ("storefront", ("STOREFRONT_UPGRADE",))]
    placed = None
    for column, kinds in homes:
        served = seq.fan_out(changes.where(F.col("kind").isin(*kinds)), assets.where(F.col(column).isNotNull()).select("asset_id", F.col(column).alias("of")), "of")
        placed = served if placed is None else placed.unionByName(served)
    held = roles.select("source", "account", "role", F.col("from_pos.block").alias("from_block"), F.col("to_pos.block").alias("to_block"))
    signed = joins.signer_attribution(placed.select("asset_id", "event_id", *AT, "kind", "subject", "before", "after", "signer"), sources, held, config.multisig, ["asset_id", "event_id"])
    out["code_change"] = signed.drop("signer")

    fronts = assets.where("storefront IS NOT NULL").select("asset_id", "token", "storefront")
    spot = ["storefront", "block", "tx"]
    bought = events.where("event_name = 'PurchaseMade'").join(fronts, (F.col("source") == F.col("storefront")) & (arg("tokenContract") == F.col("token"))).select(*spot, "log", "event_id", "token", arg("buyer").alias("buyer"), amount("amount").alias("amount"), amount("pricePaid").alias("price_paid"))
    legs = moved.join(fronts.select("asset_id", "storefront"), "asset_id").where(F.col("sender") == F.col("storefront")).select(*spot, "log", "event_id", F.col("asset_id").alias("asset"))
    taken = config.purchase_tokens.select("asset_id", F.col("address").alias("paid_in")).join(fronts.select("asset_id", "storefront"), "asset_id").select("paid_in", "storefront").distinct()
    paid = events.where("event_name = 'Transfer'").join(taken, (F.col("source") == F.col("paid_in")) & (arg("to") == F.col("storefront"))).select(*spot, "log", "event_id")
    sold = seq.sales(bought, legs, paid, fronts.select("token", F.col("asset_id").alias("asset")), spot, "log")
    out["sale"] = sold.select(F.col("asset").alias("asset_id"), *spot, "log", F.col("event_id").alias("purchase_event"), "buyer", "amount", "price_paid", "token_leg", "payment_leg")
    out["holder_balance"] = seq.running_balance(moved, "sender", "receiver", "block", "value", ["asset_id"])
    return out


def resolve_sources(assets: DataFrame, events: DataFrame, sanctions: DataFrame, pools: DataFrame, transfer_type: str, yield_type: str) -> DataFrame:
    """Which addresses speak for each asset, from which block to which (null: open), and which of their events count:
    asset_id, source_kind, address, from_block, to_block, filter_kind, filter_values.

    assets: asset_id, token, router, factory, storefront, market, live_module, live_blacklist (the reads of today, used where
    no change was ever logged); sanctions: router, address; pools: token, address, first_block. Own, router and sanctions
    sources begin where the factory registered the token (0 if it never did); modules, yield and purchase tokens follow their
    set events; a market counts by the ids of the asset's markets. The zero address is no source. An asset with many markets
    gives rows of many MB: see ``sources.io.large_rows`` before they are written as Parquet."""
    none = F.array().cast("array<string>")
    show = lambda df, kind, address, first, last=F.lit(None), how="none", values=none: df.select("asset_id", F.lit(kind).alias("source_kind"), address.alias("address"), first.cast("bigint").alias("from_block"), last.cast("bigint").alias("to_block"), F.lit(how).alias("filter_kind"), values.alias("filter_values"))
    registered = events.where("event_name = 'TokenRegistered'").groupBy(F.col("source").alias("factory"), arg("token").alias("token")).agg(F.min("block").alias("_first"))
    known = assets.join(registered, ["factory", "token"], "left").withColumn("anchor", F.coalesce("_first", F.lit(0))).drop("_first")

    def history(owner: str, name: str, value: str, where: Column | None = None) -> DataFrame:
        own = assets.where(F.col(owner).isNotNull()).select("asset_id", "token", "storefront", F.col(owner).alias("source"))
        met = events.where((F.col("event_name") == name) & arg(value).isNotNull() & (F.lit(True) if where is None else where)).join(own, "source")
        w = W.partitionBy("asset_id").orderBy(*AT)
        return met.select("asset_id", "token", "storefront", arg(value).alias("value"), F.col("block").alias("first"), F.lead("block").over(w).alias("last"))

    parts = [
        show(known, "ARC_TOKEN", F.col("token"), F.col("anchor")),
        show(known, "ROUTER", F.col("router"), F.col("anchor")),
        show(known, "FACTORY", F.col("factory"), F.lit(0)),
        show(known, "STOREFRONT", F.col("storefront"), F.lit(0)),
        show(known.join(sanctions.select("router", F.col("address").alias("_module")), "router"), "GLOBAL_SANCTIONS", F.col("_module"), F.col("anchor")),
        show(known.join(pools.select("token", F.col("address").alias("_pool"), "first_block"), "token"), "UV2_PAIR", F.col("_pool"), F.col("first_block")),
    ]
    for kind, type_id, live in (("AXIS1_MODULE", transfer_type, "live_module"), ("YIELD_BLACKLIST", yield_type, "live_blacklist")):
        walked = history("token", "SpecificRestrictionModuleSet", "moduleAddress", arg("typeId") == type_id)
        parts.append(show(walked, kind, F.col("value"), F.col("first"), F.col("last")))
        parts.append(show(known.join(walked.select("asset_id").distinct(), "asset_id", "left_anti"), kind, F.col(live), F.col("anchor")))
    paid = history("token", "YieldTokenUpdated", "newYieldToken")
    parts.append(show(paid, "YIELD_TOKEN", F.col("value"), F.col("first"), F.col("last"), "from", F.array("token")))
    bought = history("storefront", "PurchaseTokenUpdated", "newPurchaseToken")
    parts.append(show(bought, "PURCHASE_TOKEN", F.col("value"), F.col("first"), F.col("last"), "touch", F.array("storefront")))
    sides = events.where("event_name = 'CreateMarket'").select(F.col("source").alias("market"), "block", arg("id").alias("id"), F.explode(F.array_distinct(F.array(arg("loanToken"), arg("collateralToken")))).alias("token"))
    markets = known.join(sides, ["market", "token"])
    ids = markets.groupBy("asset_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    # each row shows all ids of its asset: an asset's rows are dealt, as their size grows with the square of its markets, and
    # merged, so that a task holds the ids of one asset at a time and what it sorts can spill
    dealt = markets.withColumn("_piece", F.pmod(F.xxhash64("id", "block"), F.lit(PIECES)))
    held = ids.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PIECES - 1).cast("bigint"))))
    parts.append(show(dealt.join(held.hint("merge"), ["asset_id", "_piece"]), "MORPHO", F.col("market"), F.col("block"), how="ids", values=F.col("ids")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("address").isNotNull() & (F.col("address") != ZERO_ADDRESS))
