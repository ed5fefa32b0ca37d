"""Mirror operators: range scans, upserts as joins, counters. Row order is never assumed; ties need a full order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scan_after(df: DataFrame, order: str, cursor, upper) -> DataFrame:
    """Rows in (cursor, upper]; both bounds reach the Parquet scan."""
    return df.where((F.col(order) > F.lit(cursor)) & (F.col(order) <= F.lit(upper)))


def scan_after_null_wall(df: DataFrame, order: str, payload: str) -> DataFrame:
    """Rows below the lowest row whose payload isn't there yet."""
    wall = df.agg(F.min(F.when(F.col(payload).isNull(), F.col(order))).alias("_wall"))
    return df.join(F.broadcast(wall), F.col("_wall").isNull() | (F.col(order) < F.col("_wall"))).drop("_wall")  # one row


def defer_open_group(df: DataFrame, order: str, limit: int, tie: list[str]) -> DataFrame:
    """A page of ``limit`` rows without its last group, which may go on; a page of one group is kept and flagged."""
    page = df.orderBy(order, *tie).limit(limit)
    ends = page.agg(F.count("*").alias("_n"), F.min(order).alias("_first"), F.max(order).alias("_last"))
    cut = (F.col("_n") >= limit) & (F.col("_first") < F.col("_last"))
    kept = page.join(F.broadcast(ends)).where(~cut | (F.col(order) < F.col("_last")))  # one row
    return kept.withColumn("single_group", (F.col("_n") >= limit) & (F.col("_first") == F.col("_last"))).drop("_n", "_first", "_last")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last write of each key: a max_by, so map tasks reduce a hot key before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(new_rows(target, batch, keys))


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*batch.columns)


def _both(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    mark = lambda df, p: df.select(*keys, F.struct(*[F.col(c) for c in df.columns if c not in keys]).alias(p))
    return mark(target, "old").join(mark(batch, "new"), keys, "full")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], rule) -> DataFrame:
    """Full outer join; ``rule(column, old, new)`` gives the value where both sides have the key."""
    cols = [c for c in target.columns if c not in keys]
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    out = [F.when(both, rule(c, F.col(f"old.{c}"), F.col(f"new.{c}"))).otherwise(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).alias(c) for c in cols]
    return _both(target, batch, keys).select(*keys, *out).select(*target.columns)


def upsert_changed(target: DataFrame, batch: DataFrame, keys: list[str], mutable: list[str]) -> DataFrame:
    """Insert, or update the mutable columns alone."""
    return upsert(target, batch, keys, lambda c, old, new: new if c in mutable else old)


RULES = {
    "replace": lambda old, new: new,
    "keep": lambda old, new: F.coalesce(old, new),
    "fill": lambda old, new: F.coalesce(new, old),
    "add": lambda old, new: old + new,
    "least": F.least,
    "greatest": F.greatest,
    "reset": lambda old, new: F.lit(None),
}


def upsert_merge(target: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    return upsert(target, batch, keys, lambda c, old, new: RULES[rules.get(c, "keep")](old, new))


def upsert_ranked(target: DataFrame, batch: DataFrame, keys: list[str], rank) -> DataFrame:
    """The new row wins unless its provenance ranks lower; ``rank(struct)`` gives a number."""
    wins = rank(F.col("new")) >= rank(F.col("old"))
    return upsert(target, batch, keys, lambda c, old, new: F.when(wins, new).otherwise(old))


def upsert_if_source(target: DataFrame, batch: DataFrame, keys: list[str], source: str, seed: str, fallback: str) -> DataFrame:
    """Seed rows always win; other rows overwrite fallback rows only."""
    wins = (F.col(f"new.{source}") == seed) | (F.col(f"old.{source}") == fallback)
    return upsert(target, batch, keys, lambda c, old, new: F.when(wins, new).otherwise(old))


def selector_placeholders(wanted: DataFrame, found: DataFrame, key: str, text: str, source: str, fallback: str, now: Column) -> DataFrame:
    """A row for each wanted selector: the text that was found, else the selector itself as a placeholder of the fallback
    source, dated, so that a later look can tell that it was tried."""
    both = wanted.select(key).distinct().join(found, key, "left")
    return both.withColumns({text: F.coalesce(text, key), source: F.coalesce(source, F.lit(fallback)), "looked_up_at": now})


def ordinal_refresh(target: DataFrame, batch: DataFrame, keys: list[str], ordinals: list[str]) -> DataFrame:
    return upsert_merge(target, batch, keys, {c: "fill" for c in ordinals})


def inserted_count(target: DataFrame, batch: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """True inserts of a batch; seed the running counter with ``target.groupBy(by).count()``."""
    return new_rows(target, batch, keys).groupBy(*by).agg(F.count("*").alias("inserted"))


def source_lag(cursors: DataFrame, source: DataFrame, name: str, cursor: str, order: str) -> DataFrame:
    """Source maximum beside each cursor; absent stays null."""
    tip = source.groupBy(name).agg(F.max(order).alias("source_max"))
    return cursors.join(tip, name, "left").withColumn("lag", F.col("source_max") - F.col(cursor))


def verified_lag(tip: DataFrame, verified: DataFrame, by: str, order: str) -> DataFrame:
    """Source tip minus last verified slot of each table or chain; null while either is unknown."""
    newest = tip.groupBy(by).agg(F.max(order).alias("tip"))
    checked = verified.groupBy(by).agg(F.max(order).alias("verified"))
    return newest.join(checked, by, "full").withColumn("lag", F.col("tip") - F.col("verified"))


def slot_density(df: DataFrame, order: str, start, n: int) -> DataFrame:
    own = df.where((F.col(order) > F.lit(start)) & (F.col(order) <= F.lit(start) + n))
    return own.agg((F.count("*") / F.greatest(F.count_distinct(order), F.lit(1))).alias("density"))


def flatten_params(df: DataFrame, column: str = "params") -> DataFrame:
    inner = [F.col(f"{column}.{f.name}").alias(f"{column}_{f.name}") for f in df.schema[column].dataType.fields]
    return df.select(*[c for c in df.columns if c != column], *inner)


def resolve_sender(origination: Column, source: Column, decoded: Column) -> Column:
    """Unsigned rows trust the source's sender alone; others fall back to the decoded one."""
    return F.lower(F.when(origination == "solana_unsigned", source).otherwise(F.coalesce(source, decoded)))


def batch_announce(df: DataFrame, by: list[str], order: str, key: str, oracle: Column) -> DataFrame:
    own = F.when(~oracle, F.struct(F.col(order), F.col(key)))
    return df.groupBy(*by).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.count_if(~oracle).alias("n_app"), F.max(own)[key].alias("last_app"))


def append_only_check(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the earlier snapshot that the later one has lost or changed."""
    return old.exceptAll(new.select(*old.columns))


def delete_scope(target: DataFrame, scope: Column) -> DataFrame:
    """All rows but those in scope; an unknown scope keeps the row."""
    return target.where(~F.coalesce(scope, F.lit(False)))
