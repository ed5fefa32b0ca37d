"""Segmented scans: windows over the whole order of one key, cut into segments of its positions.

A key's history is dealt by ranges of 2**bits positions, so one hot key spreads over as many tasks as it has segments. Each
segment is reduced to a small summary on the map side (its last state, its sum, its first close); the summaries are
scanned in order per key, and what each segment inherits goes to it as a row of its own, the seed, before its first row.
The windows then run per key and segment. A block holds a bounded number of rows, so a segment does, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StructType, TimestampNTZType, TimestampType

#: Positions of a segment, as a power of two: some hours of blocks.
BITS = 14
#: Most rows that a sweep gives at once.
MATCHES = 1 << 16


def segment(df: DataFrame, position: str, bits: int | None) -> Column:
    """The range that a position is in: of its first part, if it has parts; of seconds or days, for times. One range for all
    where ``bits`` is None, and for kinds without a fixed step."""
    at, kind = F.col(position), df.schema[position].dataType
    while isinstance(kind, StructType):
        at, kind = at[kind[0].name], kind[0].dataType
    if bits is None:
        return F.lit(0).cast("bigint")
    if isinstance(kind, IntegralType):
        return F.shiftright(at.cast("bigint"), bits)
    if isinstance(kind, DateType):
        return F.shiftright(F.unix_date(at).cast("bigint"), bits)
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.shiftright(F.unix_micros(at.cast("timestamp")), bits + 20)
    return F.lit(0).cast("bigint")


def sequence(keys: list[str], *order: str) -> W:
    """The order of a segment's rows: seeds first, tails last."""
    return W.partitionBy(*keys, "_seg").orderBy("_side", *order)


def before(keys: list[str]) -> W:
    return W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)


def after(keys: list[str]) -> W:
    return W.partitionBy(*keys).orderBy("_seg").rowsBetween(1, W.unboundedFollowing)


def summaries(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """One row for each key and segment: small, as it is summed before the shuffle."""
    return rows.groupBy(*keys, "_seg").agg(*[v.alias(k) for k, v in values.items()])


def seeded(rows: DataFrame, *ends: tuple[int, DataFrame]) -> DataFrame:
    """``rows`` (side 1) with the rows that segments inherit: seeds (side 0) and tails (side 2)."""
    out = rows.withColumn("_side", F.lit(1))
    for side, more in ends:
        out = out.unionByName(more.withColumn("_side", F.lit(side)), allowMissingColumns=True)
    return out


def carried_last(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with a seed in each segment that has a past: the last non-null ``value`` before it."""
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    held = summaries(rows, keys, _last=latest).select(*keys, "_seg", F.last("_last", ignorenulls=True).over(before(keys)).alias(value))
    return seeded(rows, (0, held.where(F.col(value).isNotNull())))


def carried_sum(rows: DataFrame, keys: list[str], value: str, total: Callable[..., Column]) -> DataFrame:
    """``rows`` with a seed in each segment that has a past: the sum of ``value`` before it. ``total(column, window or None)``."""
    held = summaries(rows, keys, _sum=total(F.col(value), None)).select(*keys, "_seg", F.row_number().over(W.partitionBy(*keys).orderBy("_seg")).alias("_n"), total(F.col("_sum"), before(keys)).alias(value))
    return seeded(rows, (0, held.where("_n > 1").drop("_n")))


def union_of(spans: DataFrame, keys: list[str], lo: str, hi: str, closed: bool = False, bits: int | None = BITS) -> DataFrame:
    """keys, ``lo``, ``hi``: few spans that hold the positions of each key's ``spans`` (null end: open) and no others, however
    often those overlap or repeat. Of the ones that begin at or before a position, the last reaches furthest. Spans that touch
    are one; two may overlap only where a segment of 2**bits positions begins. Null keys and beginnings are left out."""
    some = F.col(lo).isNotNull() & (F.col(hi).isNull() | ((F.col(hi) >= F.col(lo)) if closed else (F.col(hi) > F.col(lo))))
    for k in keys:
        some &= F.col(k).isNotNull()
    # an open end is beyond all others
    reach = F.struct(F.col(hi).isNull().alias("open"), F.col(hi).alias("end"))
    begun = spans.where(some).groupBy(*keys, lo).agg(F.max(reach).alias("_reach"))
    rows = carried_sum(begun.withColumn("_seg", segment(begun, lo, bits)), keys, "_reach", lambda c, w: F.max(c) if w is None else F.max(c).over(w))
    w, at = sequence(keys, lo), F.col("_past")
    past = F.max("_reach").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = at.isNull() | (~at["open"] & (at["end"] < F.col(lo)))
    placed = rows.withColumn("_past", past).where("_side = 1").withColumn("_new", apart).withColumn("_n", F.count_if("_new").over(w))
    out = placed.groupBy(*keys, "_seg", "_n").agg(F.min(lo).alias(lo), F.max("_reach").alias("_reach"), F.min_by("_past", lo).alias("_past"))
    # what a segment inherits may hold its first span already
    return out.where(at.isNull() | (F.col("_reach") > at)).select(*keys, lo, F.col("_reach.end").alias(hi))


def parts_of(df: DataFrame, position: str) -> list[Column]:
    """A position as whole numbers, first part first; a time as microseconds."""

    def flat(at: Column, kind: object) -> list[Column]:
        if isinstance(kind, StructType):
            return [c for f in kind for c in flat(at[f.name], f.dataType)]
        if isinstance(kind, TimestampType | TimestampNTZType):
            return [F.unix_micros(at.cast("timestamp"))]
        if isinstance(kind, DateType):
            return [F.unix_date(at).cast("bigint")]
        if not isinstance(kind, IntegralType):
            raise ValueError(f"a position must be of whole numbers or times, {position} is {kind.simpleString()}")
        return [at.cast("bigint")]

    return flat(F.col(position), df.schema[position].dataType)


def with_keys_of(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df``, without most of those whose keys ``others`` does not have: one row of 2**15 bits tells which hashes it has,
    so the rows that go are not shuffled. Where keys are many, none go."""
    place = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(1 << 15))
    bits = others.agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(bits)).where(F.getbit(byte, place % 8) == 1).select(*df.columns)  # one row


def sweep_join(points: DataFrame, spans: DataFrame, keys: list[str], position: str, lo: str = "from_pos", hi: str = "to_pos", closed: bool = False, bits: int = BITS, buckets: int | None = None) -> DataFrame:
    """Points with the spans of their keys that hold them: half-open (null end: open), or ``closed`` at both ends. The columns are
    those of the points and those of the spans that are no keys. Spans may overlap; null keys, positions and beginnings meet nothing.

    Points are dealt by key and range of 2**bits positions. A span goes to those ranges that it meets and that have points of
    its key, so that it makes no row that finds nothing but at its two ends. In a task the points of each range are put in
    order once and each span finds its first and last one there: no pair is made that is no match, and matches are given on by
    ``MATCHES``, so a task holds its points and spans but never all pairs. Most points of keys without spans are not dealt. A key's ranges are
    one row, of as many numbers as the whole order has ranges. ``buckets``: groups of ranges, 8 for each shuffle partition."""
    n = buckets or 8 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = len(parts_of(points, position))
    if len(parts_of(spans, lo)) != width:
        raise ValueError(f"{position} and {lo} have different parts")
    named = lambda df, at, mark: [c.alias(f"_{mark}{k}") for k, c in enumerate(parts_of(df, at))]
    key = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    ids = [f"_key{i}" for i in range(len(keys))]
    known = lambda df, at: [F.col(c).isNotNull() for c in (*keys, at)]

    def all_of(conditions: list[Column]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out &= c
        return out

    own = with_keys_of(points.where(all_of(known(points, position))), spans, keys).select(*key, segment(points, position, bits).alias("_seg"), F.struct(*points.columns).alias("_point"), *named(points, position, "lo"))
    ends = spans.where(all_of(known(spans, lo))).select(*key, segment(spans, lo, bits).alias("_from"), segment(spans, hi, bits).alias("_to"), F.struct(*[c for c in spans.columns if c not in keys]).alias("_span"), *named(spans, lo, "lo"), *named(spans, hi, "hi"))
    ranges = own.groupBy(*ids).agg(F.collect_set("_seg").alias("_ranges"))
    met = F.filter("_ranges", lambda r: (r >= F.col("_from")) & (F.col("_to").isNull() | (r <= F.col("_to"))))
    dealt = ends.join(ranges, ids).withColumn("_seg", F.explode(met)).drop("_ranges", "_from", "_to")
    group = F.to_json(F.struct(*[F.col(i).cast("string").alias(i) for i in ids], "_seg"))
    placed = lambda df: df.withColumns({"_group": group, "_bucket": F.pmod(F.xxhash64(*ids, "_seg"), F.lit(n)).cast("int")}).drop(*ids, "_seg")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        left, right = both.filter(both.column("_is_point")), both.filter(pc.invert(both.column("_is_point")))
        del both
        groups = pa.chunked_array([*left.column("_group").chunks, *right.column("_group").chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
        p, s = len(left), len(right)
        column = lambda t, name: t.column(name).to_numpy()
        ended = ~np.asarray(right.column("_hi0").is_null())
        last = [right.column(f"_hi{k}").fill_null(0).to_numpy() for k in range(width)]
        parts = [np.concatenate([column(left, f"_lo{k}"), column(right, f"_lo{k}"), last[k]]) for k in range(width)]
        parts.insert(0, np.concatenate([groups[:p], groups[p:], groups[p:]]))
        order = np.lexsort(parts[::-1])
        new = np.zeros(len(order), bool)
        for part in parts:
            new[1:] |= part[order][1:] != part[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        line = np.argsort(rank[:p], kind="stable")
        at = rank[:p][line]
        first = np.searchsorted(at, rank[p : p + s], "left")
        end = np.searchsorted(at, rank[p + s :], "right" if closed else "left")
        end = np.where(ended, end, np.searchsorted(groups[:p][line], groups[p:], "right"))
        points, held = left.column("_point").combine_chunks(), right.column("_span").combine_chunks()
        for place, span in matches(first, end, MATCHES):
            yield pa.RecordBatch.from_arrays([points.take(pa.array(line[place])), held.take(pa.array(span))], ["_point", "_span"])

    shape = StructType([own.schema["_point"], ends.schema["_span"]])
    both = placed(own).withColumn("_is_point", F.lit(True)).unionByName(placed(dealt).withColumn("_is_point", F.lit(False)), allowMissingColumns=True)
    # matches may be far more than what is read, so tasks are not made fewer by its size
    return both.repartition(n, "_bucket").groupBy("_bucket").applyInArrow(sweep, shape).select("_point.*", "_span.*")


def matches(first: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, span) of all places first[i]..end[i] - 1 of each span i, at most ``most`` at a time."""
    found = np.maximum(end - first, 0)
    upto = np.cumsum(found)
    for low in range(0, int(upto[-1]) if len(upto) else 0, most):
        k = np.arange(low, min(low + most, int(upto[-1])))
        span = np.searchsorted(upto, k, "right")
        yield first[span] + (k - upto[span] + found[span]), span
