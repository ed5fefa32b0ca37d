"""Tables kept up to date: records folded forward, late inputs, backfills, flags and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import insert_ignore
from .seq import set_history, sliding_windows


def throughput_record(windows: DataFrame, k: int, w: int, rate: str = "app_tps") -> DataFrame:
    """The best windows that k disjoint ones can be chosen from, for good: k * (2w - 1) rows at most.

    The disjoint ones alone would not do: a later window can rule one of them out and so let in what it had ruled out.
    """
    return windows.where(F.col("elapsed") > 0).orderBy(F.desc(rate), "from_block").limit(k * (2 * w - 1))


def merge_record(record: DataFrame, points: DataFrame, cursor: int, k: int, w: int, min_elapsed: int, rate: str = "app_tps") -> DataFrame:
    """The record after points past the cursor: windows that end past it, built with the w - 1 points before it."""
    before = points.where(F.col("block") <= cursor).orderBy(F.desc("block")).limit(w - 1)
    new = sliding_windows(points.where(F.col("block") > cursor).unionByName(before), w, min_elapsed).where(F.col("to_block") > cursor)
    return throughput_record(record.unionByName(new), k, w, rate)


def recheck_window(feed: DataFrame, late: DataFrame, keys: list[str], position: str, tip: int, n: int, done: Column) -> DataFrame:
    """Rows of the last n positions up to the tip that were not done and whose late input has come."""
    trailing = feed.where((F.col(position) > tip - n) & (F.col(position) <= tip) & ~F.coalesce(done, F.lit(False)))
    return trailing.join(late, keys, "left_semi")


def backfill_flag(rows: DataFrame, marked: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """The flag set on rows that ``marked`` has; others keep theirs, null as false."""
    hits = marked.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, keys, "left").withColumn(flag, F.coalesce(F.col("_hit"), F.col(flag), F.lit(False))).drop("_hit")


def in_gaps(gaps: DataFrame, logs: DataFrame, source: str, position: str) -> DataFrame:
    """Logs of a gap's source within its range; overlapping gaps give a log once."""
    spans = gaps.where(F.col("from_slot").isNotNull()).select(F.col(source).alias("_source"), "from_slot", "to_slot")
    return logs.join(spans, (F.col(source) == F.col("_source")) & F.col(position).between(F.col("from_slot"), F.col("to_slot")), "left_semi")


def backfill(stored: DataFrame, gaps: DataFrame, logs: DataFrame, source: str, position: str, keys: list[str], decode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the gaps lack is decoded again and added; rows that are there stay as they are."""
    return insert_ignore(stored, decode(in_gaps(gaps, logs, source, position)), keys)


def pick_oldest_sane(candidates: DataFrame, key: str, text: str, ident: str, longest: int = 512) -> DataFrame:
    """The text with the lowest id among those in ASCII of up to ``longest`` characters."""
    sane = candidates.where(F.col(text).rlike(r"^[\x00-\x7f]*$") & (F.length(text) <= longest))
    return sane.groupBy(key).agg(F.min_by(text, ident).alias(text))


def count_check(parsed: DataFrame, stated: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Groups whose parsed rows differ in number from the stated one; a side that lacks the group counts 0."""
    own = parsed.groupBy(*keys).agg(F.count("*").alias("parsed"))
    both = own.join(stated.select(*keys, F.col(n).alias("stated")), keys, "full")
    return both.select(*keys, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("parsed", "stated")]).where("parsed <> stated")


def config_check(assets: DataFrame, routers: DataFrame, key: str) -> None:
    """An error before any work where an asset's router is not configured; it names ten of them at most."""
    missing = [r[0] for r in assets.join(routers, key, "left_anti").select(key).distinct().orderBy(key).limit(10).collect()]
    if missing:
        raise ValueError(f"no configuration for {', '.join(map(str, missing))}")


def market_match(events: DataFrame, markets: DataFrame, assets: DataFrame) -> DataFrame:
    """Events of markets that lend an asset or take it as collateral, with the asset; one row where it is both.

    ``markets`` (market, loan, collateral) becomes a row a side, so both joins are on equality.
    """
    sides = markets.select("market", F.explode(F.array_distinct(F.array("loan", "collateral"))).alias("asset"))
    return events.join(sides.join(assets.select("asset").distinct(), "asset", "left_semi"), "market")


def source_intervals(fixed: DataFrame, changes: DataFrame, asset: str = "asset", role: str = "role", address: str = "address", order: str = "position") -> DataFrame:
    """Which address serves an asset in which role, from where to where.

    ``fixed`` rows come from configuration and hold from the start; ``changes`` of a role each end the one before. A
    change to null ends the role. A fixed address that a role's first change replaces ends there.
    """
    first = changes.groupBy(asset, role).agg(F.min(order).alias("to_pos"))
    own = fixed.select(asset, role, address).distinct().join(first, [asset, role], "left").select(asset, role, address, F.lit(None).cast(changes.schema[order].dataType).alias("from_pos"), "to_pos")
    later = set_history(changes, [asset, role], order, address).where("value IS NOT NULL").select(asset, role, F.col("value").alias(address), "from_pos", "to_pos")
    return own.unionByName(later)
