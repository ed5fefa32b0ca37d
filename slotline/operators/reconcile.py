"""Scope, gaps and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discover(admitted: DataFrame, also: DataFrame, gate: DataFrame, key: str) -> DataFrame:
    return admitted.select(key).unionByName(also.select(key)).distinct().join(gate, key, "left_semi")


def merge_sources(sources: DataFrame, rank: Column) -> DataFrame:
    """One row an address: kind of highest precedence, all filters, and whether one of them lets everything through."""
    return sources.groupBy("address").agg(F.min_by("kind", rank).alias("kind"), F.array_sort(F.collect_set("filter")).alias("filters"), F.max((F.col("filter") == "none").cast("int")).cast("boolean").alias("open"))


def filter_fingerprint(kind: Column, values: Column) -> Column:
    return F.concat_ws(":", kind, F.array_join(F.array_sort(F.array_distinct(F.transform(values, F.lower))), ","))


def manifest(rows: DataFrame, by: list[str], columns: list[str], buckets: int = 256) -> DataFrame:
    """One hash a group that any change of its rows changes: rows are hashed as sorted JSON, hashes are sorted and hashed in
    ``buckets`` by their own value, and the buckets' hashes once more, so no task holds a group's text."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    hashed = rows.select(*by, F.sha2(text, 256).alias("h"))
    part = hashed.groupBy(*by, F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return part.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"]), ""), 256).alias("manifest"))


def detect_gaps(now: DataFrame, before: DataFrame, watermark: int) -> DataFrame:
    """New (address, filter) pairs whose first block the feed has passed: from there to the watermark is missing."""
    new = now.join(before, ["address", "filter"], "left_anti").groupBy("address", "filter").agg(F.min("from_block").alias("from_block"))
    return new.where(F.col("from_block") <= watermark).withColumn("to_block", F.lit(watermark))


def reopen_gaps(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps after new ones were found: one that is known reaches from the lesser start to the greater end."""
    ends = F.min("from_block").alias("from_block"), F.max("to_block").alias("to_block")
    return known.select(*keys, "from_block", "to_block").unionByName(new.select(*keys, "from_block", "to_block")).groupBy(*keys).agg(*ends)


def gap_plan(gaps: DataFrame, blocks: DataFrame, floor: int, keys: list[str] | None = None, width: int = 100_000) -> DataFrame:
    """Block ranges as slot ranges: pruned below the floor, done where no block is left. Gaps and blocks meet by equal ranges
    of ``width`` blocks; a range that a gap covers whole gives its least and greatest slot, its ends are looked up by row.
    ``keys`` name a gap (all columns but the bounds by default)."""
    keys = keys or [c for c in gaps.columns if c not in ("from_block", "to_block")]
    part = lambda c: F.floor(F.col(c) / width)
    cut = gaps.withColumn("_part", F.explode(F.sequence(part("from_block"), part("to_block"))))
    inner = (F.col("_part") > part("from_block")) & (F.col("_part") < part("to_block"))
    dealt = blocks.select("block", "slot", part("block").alias("_part"))
    sums = dealt.groupBy("_part").agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    whole = cut.where(inner).join(sums, "_part").select(*keys, "low", "high")
    edges = cut.where(~inner).join(dealt, "_part").where(F.col("block").between(F.col("from_block"), F.col("to_block"))).select(*keys, F.col("slot").alias("low"), F.col("slot").alias("high"))
    spans = whole.unionByName(edges).groupBy(*keys).agg(F.min("low").alias("from_slot"), F.max("high").alias("to_slot"))
    status = F.when(F.col("to_slot").isNull(), "done").when(F.col("from_slot") < floor, "source_pruned").otherwise("open")
    return gaps.join(spans, keys, "left").withColumn("status", status)


def reconcile(stored: DataFrame, fresh: DataFrame, keys: list[str], value: str) -> DataFrame:
    """unchanged, healed or missing for each key seen on either side."""
    a, b = stored.select(*keys, F.col(value).alias("stored"), F.lit(True).alias("_s")), fresh.select(*keys, F.col(value).alias("fresh"), F.lit(True).alias("_f"))
    status = F.when(F.col("_s").isNull(), "missing").when(F.col("_f").isNull(), "unconfirmed").when(F.col("stored").eqNullSafe(F.col("fresh")), "unchanged").otherwise("healed")
    return a.join(b, keys, "full").withColumn("status", status).drop("_s", "_f")


def reconcile_transfers(stored: DataFrame, fresh: DataFrame, blocks: DataFrame, keys: list[str], value: str, slot: str, cursor: int) -> DataFrame:
    """``reconcile`` of transfers up to the cursor, each fresh one with its block; one whose transaction has no block yet is
    missing, whatever is stored. A dry run counts the statuses and writes nothing."""
    placed = fresh.where(F.col(slot) <= cursor).join(blocks.select("tx_hash", F.col("block_number")), "tx_hash", "left")
    out = reconcile(stored, placed, keys, value).join(placed.select(*keys, F.col("block_number")), keys, "left")
    return out.withColumn("status", F.when(F.col("fresh").isNotNull() & F.col("block_number").isNull(), "missing").otherwise(F.col("status")))


def reconcile_balances(stored: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """What to do with each observed balance: delete zeros, leave equals, heal the rest; and the drift."""
    both = observed.select(*keys, F.col("balance").alias("observed")).join(stored.select(*keys, F.col("balance").alias("stored")), keys, "left")
    action = F.when((F.col("observed") == 0) & F.col("stored").isNotNull(), "delete").when(F.coalesce("stored", F.lit(0)) == F.col("observed"), "ok").otherwise("heal")
    return both.withColumn("action", action).withColumn("drift", F.col("observed") - F.coalesce("stored", F.lit(0)))


def label_candidates(labels: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    own = labels.where(F.col("has_code") & ~F.col("provenance").isin("verified", "registry") & (F.col("verified_checked_at").isNull() | (F.col("verified_checked_at") < now - F.make_interval(days=F.lit(ttl_days)))))
    return own.orderBy(F.asc_nulls_first("verified_checked_at"), "address")


def incomplete_metadata(tokens: DataFrame) -> DataFrame:
    return tokens.where("name IS NULL OR kind IS NULL OR gated IS NULL")


def evidence_merge(known: DataFrame, new: DataFrame, key: list[str], content: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """existing, conflict, new or invalid for each submitted record, with the first shape rule that it breaks (rules: name to
    a condition that must hold; unknown counts as broken). A record submitted twice with equal content is one record; with
    unequal content it is a conflict."""
    broken = None
    for name, good in (rules or {}).items():
        bad = ~F.coalesce(good, F.lit(False))
        broken = F.when(bad, name) if broken is None else broken.when(bad, name)
    marked = new.withColumn("broken", broken if broken is not None else F.lit(None).cast("string"))
    several = marked.groupBy(*key).agg(F.count_distinct(content).alias("_contents"))
    both = marked.dropDuplicates([*key, content]).join(several, key).join(known.select(*key, F.col(content).alias("_known")), key, "left")
    verdict = F.when(F.col("broken").isNotNull(), "invalid").when(F.col("_known") == F.col(content), "existing").when(F.col("_known").isNotNull() | (F.col("_contents") > 1), "conflict").otherwise("new")
    return both.withColumn("verdict", verdict).drop("_known", "_contents")


def finality_watermark(earlier: DataFrame, later: DataFrame, slot: str, digest: str, tip: int, produced: int, lag: int) -> DataFrame:
    """Last slot up to which every slot is old enough, overtaken by production, and unchanged between two looks."""
    both = later.join(earlier.select(slot, F.col(digest).alias("_was")), slot, "left")
    bad = (F.lit(tip) - F.col(slot) < lag) | (F.lit(produced) < F.col(slot) + lag) | ~F.col(digest).eqNullSafe(F.col("_was"))
    return both.agg((F.coalesce(F.min(F.when(bad, F.col(slot))), F.max(slot) + 1) - 1).alias("watermark"))


def init_watermark(tip: Column, produced: Column, lag: int) -> Column:
    return F.greatest(F.lit(-1), F.least(tip, produced) - lag)


def hold_valve(misses: DataFrame, held: DataFrame, planned: DataFrame, most: int, by: str = "worker") -> DataFrame:
    """The cursor that each worker keeps after a poll: the planned one if nothing was missed; else just below the earliest
    miss, with the number of polls it has been held there; past that slot alone once a terminal miss was held ``most`` polls.

    misses: by, slot, terminal; held: by, cursor, streak; planned: by, planned. One slot with both kinds of miss counts as
    transient. Result: by, persist, cursor and streak to hold (null: none), gave_up (the slot for the dead letters)."""
    first = misses.groupBy(by, "slot").agg(F.min(F.col("terminal").cast("int")).alias("_t")).groupBy(by).agg(F.min_by(F.struct("slot", "_t"), "slot").alias("m"))
    both = planned.join(first, by, "left").join(held.select(by, F.col("cursor").alias("_c"), F.col("streak").alias("_s")), by, "left")
    capped = F.least(F.col("planned"), F.col("m.slot") - 1)
    streak = F.when(capped == F.col("_c"), F.col("_s") + 1).otherwise(1)
    gives_up = F.coalesce((F.col("m._t") == 1) & (streak >= most), F.lit(False))
    missed = F.col("m").isNotNull()
    return both.select(
        by,
        F.when(~missed, F.col("planned")).when(gives_up, F.col("m.slot")).otherwise(capped).alias("persist"),
        F.when(missed & ~gives_up, capped).alias("cursor"),
        F.when(missed & ~gives_up, streak).alias("streak"),
        F.when(gives_up, F.col("m.slot")).alias("gave_up"),
    )
