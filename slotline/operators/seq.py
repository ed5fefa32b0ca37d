"""Sequences: windows over a global order, intervals, pairing, runs and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.functions import u256
from slotline.functions.hexabi import ZERO_ADDRESS

from . import scan
from .joins import as_of


def sliding_windows(points: DataFrame, w: int, min_elapsed: int, block: str = "block", ts: str = "ts", total: str = "total", app: str = "app", size: int = 4096) -> DataFrame:
    """Every run of ``w`` points in block order with enough time between its ends: bounds, sums, rates.

    Points are dealt to ranges of block numbers; each range also gets the ``w - 1`` points before it, found from counts
    per range, so no task sees the whole order. Block numbers must be unique.
    """
    part = F.floor(F.col(block) / size)
    dealt = points.select(F.col(block).alias("block"), F.col(ts).alias("ts"), F.col(total).alias("total"), F.col(app).alias("app"), part.alias("part"))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    own = W.partitionBy("part").orderBy("block")
    last = dealt.withColumn("back", F.row_number().over(W.partitionBy("part").orderBy(F.desc("block")))).where(F.col("back") < w)
    # the tail of a range goes to each of the w - 1 ranges after it that it is within w - 1 points of; one row a range is
    # sorted in one task here, ``size`` points at most for each
    upto = counts.withColumn("seen", F.sum("n").over(W.orderBy("part")))
    later = F.collect_list(F.struct(F.col("part").alias("to"), (F.col("seen") - F.col("n")).alias("start"))).over(W.orderBy("part").rowsBetween(1, w - 1))
    reach = upto.withColumn("later", later).select("part", "seen", F.explode("later").alias("x")).select("part", "x.to", (F.col("x.start") - F.col("seen")).alias("between")).where(F.col("between") < w - 1)
    halo = last.join(reach, "part").where(F.col("back") + F.col("between") < w).select("block", "ts", "total", "app", F.col("to").alias("part"), F.lit(False).alias("own"))
    full = dealt.withColumn("own", F.lit(True)).unionByName(halo)
    run = own.rowsBetween(-(w - 1), 0)
    made = full.select("own", F.first("block").over(run).alias("from_block"), F.col("block").alias("to_block"), (F.col("ts") - F.first("ts").over(run)).alias("elapsed"), F.sum("total").over(run).alias("total"), F.sum("app").over(run).alias("app"), F.count("*").over(run).alias("n"))
    good = made.where(F.col("own") & (F.col("n") == w) & (F.col("elapsed") >= min_elapsed))
    return good.select("from_block", "to_block", "elapsed", "total", "app", F.try_divide("total", "elapsed").alias("total_tps"), F.try_divide("app", "elapsed").alias("app_tps"))


def peak_window(windows: DataFrame, rate: str = "total_tps") -> DataFrame:
    return windows.where(F.col("elapsed") > 0).orderBy(F.desc(rate), "from_block").limit(1)


def topk_disjoint(windows: DataFrame, k: int, w: int, rate: str = "app_tps") -> DataFrame:
    """Greedy choice of k windows that share no block, best rate first. A kept window rules out at most 2 * (w - 1)
    others when block numbers are unique, so the k * (2w - 1) best decide; that bounded pool is folded in one array."""
    pool = windows.where(F.col("elapsed") > 0).orderBy(F.desc(rate), "from_block").limit(k * (2 * w - 1))
    item = F.struct((-F.col(rate)).alias("worse"), *[F.col(c) for c in windows.columns])
    kind = pool.select(item.alias("x")).schema["x"].dataType.simpleString()
    best = pool.agg(F.array_sort(F.collect_list(item)).alias("xs"))
    apart = lambda x, y: (x["to_block"] < y["from_block"]) | (y["to_block"] < x["from_block"])
    kept = F.aggregate("xs", F.array().cast(f"array<{kind}>"), lambda acc, x: F.when((F.size(acc) < k) & F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc))
    return best.select(F.posexplode(kept).alias("rank", "x")).select((F.col("rank") + 1).alias("rank"), *[F.col(f"x.{c}") for c in windows.columns])


def topk_blocks(points: DataFrame, k: int, block: str = "block", app: str = "app") -> DataFrame:
    return points.orderBy(F.desc(app), block).limit(k)


def merge_histogram(old: DataFrame, new: DataFrame, key: str, n: str) -> DataFrame:
    return old.unionByName(new).groupBy(key).agg(F.sum(n).alias(n))


def member_intervals(events: DataFrame, key: list[str], order: list[str], flag: Column, skip: Column | None = None, bits: int | None = scan.BITS) -> DataFrame:
    """Open and close positions of each key: a repeated open keeps the first, a stray close is ignored, an open end is null.
    Rows where ``skip`` holds (the zero address, for allowlists and yield blacklists) and those with a null flag count not.

    A key's order is cut into segments of 2**bits positions: each begins with the last flag before it and ends with the
    first close after it, which closes what is still open."""
    marked = events.where(~F.coalesce(skip if skip is not None else F.lit(False), F.lit(False)) & flag.isNotNull()).select(*key, *order, flag.alias("_on"))
    marked = marked.withColumn("_seg", scan.segment(marked, order[0], bits))
    ends = scan.summaries(marked, key, _last=F.max_by("_on", F.struct(*order)), _close=F.min(F.when(~F.col("_on"), F.struct(*order))))
    held = ends.select(*key, "_seg", F.last("_last").over(scan.before(key)).alias("_on"), F.min("_close").over(scan.after(key)).alias("_close"))
    seeds = held.where("_on IS NOT NULL").select(*key, "_seg", "_on")
    tails = held.where("_close IS NOT NULL").select(*key, "_seg", "_close.*", F.lit(False).alias("_on"))
    w = scan.sequence(key, *order)
    turns = scan.seeded(marked, (0, seeds), (2, tails)).withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False))).where("_on <> _was AND _side > 0")
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return turns.withColumn("from_pos", at).withColumn("to_pos", F.lead(at).over(w)).where("_on").select(*key, "from_pos", "to_pos")


def state_intervals(events: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """Runs of equal state with their bounds; nothing stands before the first event."""
    w = W.partitionBy(*key).orderBy(*order)
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    turns = events.select(*key, *order, value.alias("state")).withColumn("_was", F.lag("state").over(w)).where("_was IS NULL OR NOT (_was <=> state)")
    return turns.withColumn("from_pos", at).withColumn("to_pos", F.lead(at).over(w)).select(*key, "state", "from_pos", "to_pos")


def epoch_intervals(events: DataFrame, key: list[str], order: list[str], module: Column) -> DataFrame:
    """Spells of a registered module; each event closes what is open, and opens anew where ``module`` is not null."""
    w = W.partitionBy(*key).orderBy(*order)
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    marked = events.select(*key, *order, module.alias("module")).withColumn("to_pos", F.lead(at).over(w))
    return marked.where(F.col("module").isNotNull()).select(*key, "module", at.alias("from_pos"), "to_pos")


def set_history(events: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    return events.select(*key, F.col(value).alias("value"), F.col(order).alias("from_pos"), F.lead(order).over(W.partitionBy(*key).orderBy(order)).alias("to_pos"))


def lifo_pair(events: DataFrame, group: list[str], order: list[str], is_open: Column, is_close: Column, ident: str, bits: int | None = scan.BITS) -> DataFrame:
    """Each close with the nearest open before it that is still unmatched, or null.

    Level before a row = running sum of +1 / -1 minus the least of 0 and its running minimum; an open gets level + 1, a
    close its level, and equal levels pair up with the last open before. A group's order is cut into segments of 2**bits
    positions: one inherits the sum and the least sum before it, then, at each level, the last open before it. None, for
    groups of bounded size such as a transaction, leaves a group whole.
    """
    step = F.when(is_open, 1).when(is_close, -1)
    marked = events.where(is_open | is_close).select(*group, *order, F.col(ident).alias("_id"), step.cast("bigint").alias("_step"))
    marked = marked.withColumn("_seg", scan.segment(marked, order[0], bits))
    w = scan.sequence(group, *order)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    if bits is None:
        rows, start, least = marked.withColumn("_side", F.lit(1)), zero, zero
    else:
        own = W.partitionBy(*group, "_seg").orderBy(*order)
        sums = scan.summaries(marked.withColumn("_sum", F.sum("_step").over(own.rowsBetween(W.unboundedPreceding, 0))), group, _all=F.sum("_step"), _low=F.min("_sum"))
        begun = sums.withColumn("_start", F.coalesce(F.sum("_all").over(scan.before(group)), zero))
        seeds = begun.select(*group, "_seg", "_start", F.least(zero, F.coalesce(F.min(F.col("_start") + F.col("_low")).over(scan.before(group)), zero)).alias("_least"), zero.alias("_step"))
        rows = scan.seeded(marked, (0, seeds))
        start, least = (F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0)) for c in ("_start", "_least"))
        rows = rows.withColumns({"_start": start, "_least": least})
        start, least = F.col("_start"), F.col("_least")
    rows = rows.withColumn("_sum", start + F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    level = F.coalesce(F.lag("_sum").over(w), start) - F.least(least, F.coalesce(F.min("_sum").over(past), zero))
    levelled = rows.withColumn("_level", F.when(F.col("_step") == 1, level + 1).otherwise(level)).where("_step <> 0").select(*group, *order, "_id", "_step", "_level", "_seg")
    # opens hold their id; a close takes the last one at its level
    held = levelled.withColumn("_open", F.when(F.col("_step") == 1, F.struct("_id")))
    keys = [*group, "_level"]
    chained = held.withColumn("_side", F.lit(1)) if bits is None else scan.carried_last(held, keys, order, "_open")
    matched = chained.withColumn("open_id", F.when(F.col("_level") > 0, F.last("_open", ignorenulls=True).over(scan.sequence(keys, *order).rowsBetween(W.unboundedPreceding, -1))["_id"]))
    return matched.where("_step = -1").select(*group, F.col("_id").alias("close_id"), "open_id")


def screening_gaps(pairs: DataFrame, spells: DataFrame, key: list[str], position: str) -> DataFrame:
    """Unpaired closes inside a spell of their own key, found by one sweep over each range of positions."""
    own = pairs.where(F.col("open_id").isNull())
    held = spells.select(*key, F.col("from_pos").alias("_from"), F.col("to_pos").alias("_to"))
    return scan.sweep_join(own, held, key, position, "_from", "_to").select(*own.columns)


def register_epochs(events: DataFrame, key: list[str], order: list[str], type_id: str) -> DataFrame:
    """Spells of a router's global module of one type, from its three events. A registration (global, with a readable module)
    and a removal close what is open; an update does, too, and opens its module if readable; a zero module opens nothing.
    events: event_name, type_id, is_global, module."""
    name, module = F.col("event_name"), F.nullif(F.col("module"), F.lit(ZERO_ADDRESS))
    register = (name == "ModuleTypeRegistered") & F.coalesce(F.col("is_global"), F.lit(False)) & F.col("module").isNotNull()
    own = events.where((F.col("type_id") == type_id) & (register | name.isin("ModuleTypeRemoved", "GlobalImplementationUpdated")))
    return epoch_intervals(own, key, order, F.when(name != "ModuleTypeRemoved", module))


def yield_runs(events: DataFrame, key: list[str], order: list[str], is_credit: Column, is_close: Column, amount: Column, total: Column, limbs: bool = False) -> DataFrame:
    """Runs of credits ended by closes: number, credits, sum, stated total, remainder, over_credit; an open last run needs a
    credit; a close without a readable total still ends its run. ``limbs``: amounts are 256-bit."""
    own = numbered_runs(events, key, order, is_close)
    credit, close = F.when(is_credit, amount), F.when(is_close, total)
    counts = [F.count_if(is_credit).alias("credits"), F.count_if(is_close).alias("closes"), F.first(close, ignorenulls=True).alias("stated")]
    if limbs:
        grouped = own.groupBy(*key, "run").agg(*counts, u256.sum_of(credit).alias("_sum"))
        grouped = grouped.withColumn("credited", u256.normalise(u256.of(lambda n: F.coalesce(F.col(f"_sum.{n}"), u256.zero()))))
        less = u256.minus(F.col("stated"), F.col("credited"))
        left = F.when(F.col("stated").isNotNull(), u256.normalise(less))
        over = u256.sign(left) < 0
    else:
        grouped = own.groupBy(*key, "run").agg(*counts, F.coalesce(F.sum(credit), F.lit(0)).alias("credited"))
        left = F.col("stated") - F.col("credited")
        over = left < 0
    return grouped.where("closes > 0 OR credits > 0").select(*key, "run", "credits", "credited", "stated", (F.col("closes") > 0).alias("closed"), left.alias("remainder"), F.coalesce(over, F.lit(False)).alias("over_credit"))


def numbered_runs(events: DataFrame, key: list[str], order: list[str], is_close: Column, bits: int | None = scan.BITS) -> DataFrame:
    """Events with the number of closes before them, counted within segments of a key's order that are seeded with the count
    before them."""
    total = lambda c, over: F.sum(c) if over is None else F.sum(c).over(over)
    marked = events.withColumns({"_close": F.when(is_close, 1).otherwise(0).cast("bigint"), "_seg": scan.segment(events, order[0], bits)})
    past = scan.sequence(key, *order).rowsBetween(W.unboundedPreceding, -1)
    counted = scan.carried_sum(marked, key, "_close", total).withColumn("run", F.coalesce(F.sum("_close").over(past), F.lit(0).cast("bigint")))
    return counted.where("_side = 1").drop("_close", "_seg", "_side")


def yield_credits(events: DataFrame, key: list[str], order: list[str], is_credit: Column, is_close: Column, holder: Column, amount: Column) -> DataFrame:
    """Each credit with its run; credits without a holder or an amount are in no list."""
    own = numbered_runs(events, key, order, is_close).where(is_credit & holder.isNotNull() & amount.isNotNull())
    return own.select(*key, "run", *order, holder.alias("holder"), amount.alias("share"))


def running_balance(transfers: DataFrame, debit: str, credit: str, block: str, amount: str, by: list[str] = (), zero: str = ZERO_ADDRESS, bits: int | None = scan.BITS) -> DataFrame:
    """Exact balance (limbs) of each address at the end of each block it moves in, and whether it is negative. ``amount``:
    limbs. A transfer that lacks a side or an amount is skipped whole; the zero address has no balance.

    Moves of a block are summed first, and an address's blocks are cut into segments of 2**bits, each seeded with the sum
    before it, so a task sees a row a block of a segment, not a row a transfer."""
    whole = transfers.where(F.col(debit).isNotNull() & F.col(credit).isNotNull() & F.col(amount).isNotNull())
    sides = F.array(F.struct(F.col(debit).alias("address"), u256.negate(F.col(amount)).alias("u")), F.struct(F.col(credit).alias("address"), F.col(amount).alias("u")))
    legs = whole.select(*by, F.col(block).alias("block"), F.explode(sides).alias("x")).select(*by, "block", "x.*").where(F.col("address") != zero)
    moved = legs.groupBy(*by, "address", "block").agg(u256.sum_of(F.col("u")).alias("u"))
    keys = [*by, "address"]
    rows = scan.carried_sum(moved.withColumn("_seg", scan.segment(moved, "block", bits)), keys, "u", u256.sum_of)
    upto = scan.sequence(keys, "block").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select(*keys, "block", "_side", u256.sum_of(F.col("u"), upto).alias("u")).where("_side = 1").select(*keys, "block", u256.normalise(F.col("u")).alias("balance"))
    return summed.withColumn("alarm", u256.sign(F.col("balance")) < 0)


def change_chain(events: DataFrame, subject: list[str], order: list[str], after: str) -> DataFrame:
    """Each change with the value before it in the same subject; null first, null after a removal."""
    w = W.partitionBy(*subject).orderBy(*order)
    return events.select(*subject, *order, F.lag(after).over(w).alias("before"), F.col(after).alias("after"))


#: The events that change code, the argument that holds the new address, and the kind of change.
CODE_EVENTS = (
    ("Upgraded", "implementation", "UPGRADE"),
    ("TokenUpgraded", "newImplementation", "UPGRADE"),
    ("SpecificRestrictionModuleSet", "moduleAddress", "MODULE_SET"),
    ("ModuleLinked", "moduleAddress", "MODULE_LINKED"),
    ("ModuleTypeRegistered", "globalImplementation", "ROUTER_GLOBAL"),
    ("GlobalImplementationUpdated", "newGlobalImplementation", "ROUTER_GLOBAL"),
    ("ModuleTypeRemoved", None, "ROUTER_GLOBAL"),
)


def code_changes(events: DataFrame, order: list[str]) -> DataFrame:
    """kind, subject, before, after of every change of code. events: source, source_kind, event_name, args (a map), order.

    Own upgrades and those through the factory share the token as subject; a storefront's upgrades are a kind of their own;
    modules are chained by token and type, router globals by router and type. A change whose address cannot be read goes,
    but a removal stays with null after. One log is a change of its own, however alike two are."""
    arg = lambda k: F.try_element_at("args", F.lit(k))
    name = F.col("event_name")
    kind = F.when((name == "Upgraded") & (F.col("source_kind") == "STOREFRONT"), "STOREFRONT_UPGRADE")
    after = None
    for event, key, label in CODE_EVENTS:
        kind = kind.when(name == event, label)
        if key:
            after = F.when(name == event, arg(key)) if after is None else after.when(name == event, arg(key))
    token = F.when(name == "TokenUpgraded", arg("token")).when(name == "ModuleLinked", arg("tokenAddress")).otherwise(F.col("source"))
    subject = F.concat_ws(":", token, F.when(name == "ModuleLinked", arg("moduleType")).when(F.col("kind").isin("MODULE_SET", "ROUTER_GLOBAL"), arg("typeId")))
    taken = events.where(name.isin(*[e for e, *_ in CODE_EVENTS]) & ((name != "Upgraded") | F.col("source_kind").isin("ARC_TOKEN", "STOREFRONT"))).withColumn("kind", kind)
    taken = taken.withColumns({"subject": subject, "after": after, "of": token}).where((name == "ModuleTypeRemoved") | F.col("after").isNotNull())
    taken = taken.where(F.col("of").isNotNull() & (~F.col("kind").isin("MODULE_SET", "MODULE_LINKED", "ROUTER_GLOBAL") | F.col("subject").contains(":")))
    w = W.partitionBy("kind", "subject").orderBy(*order)
    return taken.withColumn("before", F.lag("after").over(w))


def fan_out(chain: DataFrame, assets: DataFrame, subject: str) -> DataFrame:
    """A shared source's changes once for each asset that it serves; each copy is attributed on its own after this."""
    return chain.join(assets, subject)


def merge_by_position(named: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Several sources' events as one table in one total order: ``rank`` by position, ties by the source's name. The rank is
    counted over ranges of the first position part, so no task holds all."""
    out = None
    for name, f in sorted(named.items()):
        f = f.withColumn("source_name", F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    at = [*order, "source_name"]
    parted = out.withColumn("_part", F.floor(F.col(order[0]) / 10_000))
    sums = parted.groupBy("_part").count().withColumn("_before", F.sum("count").over(W.orderBy("_part")) - F.col("count")).drop("count")
    local = parted.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*at)))
    return local.join(sums, "_part").withColumn("rank", F.col("_n") + F.col("_before")).drop("_n", "_before", "_part")


def spell_moves(gates: DataFrame, transfers: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ungated spells after a first gated one, and the transfers with the spell (from_pos) they fall in.

    The last change at or before a transfer is carried forward to it in one order of changes and transfers, so nothing is
    joined by range and a hot key makes no pairs."""
    w = W.partitionBy(*key).orderBy("from_pos").rowsBetween(W.unboundedPreceding, -1)
    marked = gates.withColumn("_open", ~F.col("state") & (F.coalesce(F.max(F.col("state").cast("int")).over(w), F.lit(0)) == 1))
    spells = marked.where("_open").select(*key, "from_pos", "to_pos")
    moved = as_of(transfers, marked.withColumn("_at", F.when(F.col("_open"), F.col("from_pos"))).select(*key, "from_pos", "_at"), key, "pos", "_at")
    return spells, moved.where("_at IS NOT NULL").withColumnRenamed("_at", "from_pos")


def exposure_windows(gates: DataFrame, transfers: DataFrame, listed: DataFrame, key: list[str], zero: str = ZERO_ADDRESS) -> DataFrame:
    """Ungated spells after a first gated one, classed by what moved in them: OTHER if anything moved between third parties,
    else CLAWBACK for a mint and a burn, ISSUANCE for a mint, OTHER for the rest; with the positions of third-party moves
    and their recipients that were never on the allowlist.

    gates: key, state (gated), from_pos, to_pos; transfers: key, pos, sender, receiver (zero address: mint, burn; null is
    no zero address); listed: key, address ever on the allowlist. The lists of a spell are one row, as in the audit's flags;
    ``spell_moves`` has them as rows.
    """
    spells, moved = spell_moves(gates, transfers, key)
    known = listed.select(*key, F.col("address").alias("receiver"), F.lit(True).alias("_listed")).distinct()
    moved = moved.join(known, [*key, "receiver"], "left")
    out, into = (F.coalesce(F.col(c) == zero, F.lit(False)) for c in ("sender", "receiver"))
    third = ~out & ~into
    grouped = moved.groupBy(*key, "from_pos").agg(F.count_if(out & ~into).alias("mints"), F.count_if(into & ~out).alias("burns"), F.count_if(third).alias("third_party"), F.array_sort(F.collect_list(F.when(third, F.col("pos")))).alias("third_party_positions"), F.array_sort(F.collect_set(F.when(third & F.col("_listed").isNull(), F.col("receiver")))).alias("never_listed"))
    spans = spells.join(grouped, [*key, "from_pos"], "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("mints", "burns", "third_party")}
    lists = {c: F.coalesce(c, F.array().cast(grouped.schema[c].dataType)) for c in ("third_party_positions", "never_listed")}
    kind = F.when(F.col("third_party") > 0, "OTHER").when((F.col("mints") > 0) & (F.col("burns") > 0), "CLAWBACK").when(F.col("mints") > 0, "ISSUANCE").otherwise("OTHER")
    return spans.withColumns({**counts, **lists}).withColumn("kind", kind)


def contiguity(df: DataFrame, number: str) -> DataFrame:
    """Gaps in a numbering: last number before and first after."""
    keyed = df.select(F.col(number).alias("n")).distinct().withColumn("part", F.floor(F.col("n") / 1_000_000))
    ends = keyed.groupBy("part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    inner = keyed.select(F.col("n").alias("after"), F.lead("n").over(W.partitionBy("part").orderBy("n")).alias("before"))
    outer = ends.select(F.col("high").alias("after"), F.lead("low").over(W.orderBy("part")).alias("before"))
    return inner.unionByName(outer).where("before - after > 1")


def sales(purchases: DataFrame, token_legs: DataFrame, payment_legs: DataFrame, tokens: DataFrame, tx: list[str], log: str) -> DataFrame:
    """Each purchase with the nearest unmatched token leg of its asset and payment leg of any asset before it in its transaction.

    ``tokens`` (token, asset) names the assets; others' purchases go. A purchase without buyer, amount or price goes before
    pairing, so it takes no leg. A leg that is missing is null. All inputs carry ``tx``, ``log`` and event_id; token legs asset.
    """
    whole = F.col("buyer").isNotNull() & F.col("amount").isNotNull() & F.col("price_paid").isNotNull()
    bought = purchases.where(whole).join(tokens.select("token", "asset"), "token")
    kind = F.col("_leg")
    mark = lambda df, on, *more: df.select(*tx, *more, log, "event_id", F.lit(on).alias("_leg"))
    by_asset = lifo_pair(mark(bought, False, "asset").unionByName(mark(token_legs, True, "asset")), [*tx, "asset"], [log], kind, ~kind, "event_id", bits=None)
    by_tx = lifo_pair(mark(bought, False).unionByName(mark(payment_legs, True)), tx, [log], kind, ~kind, "event_id", bits=None)
    out = bought.join(by_asset.select(F.col("close_id").alias("event_id"), F.col("open_id").alias("token_leg")), "event_id", "left")
    return out.join(by_tx.select(F.col("close_id").alias("event_id"), F.col("open_id").alias("payment_leg")), "event_id", "left")
