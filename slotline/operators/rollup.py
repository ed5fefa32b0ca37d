"""Rates and histograms of any range of blocks from summaries at doubling widths.

Points are summed once to cells of 2**bits positions, pairs of cells to cells of twice the width, and so on. A range is then
a few cells of each width, two at most, and two edges of less than the least width, which are read from the points; what a
query reads grows with the logarithm of the range. Cells are sums, counts and ends, so they merge in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.functions.hexabi import histogram_bucket

BITS, LEVELS = 10, 20
SUMS = ("blocks", "filled", "total", "app")


def cells(points: DataFrame, bits: int = BITS) -> DataFrame:
    """level 0: cell, bucket of the histogram, blocks, filled, total, app, first_ts, last_ts. points: block, ts, total, app."""
    of = points.select(F.shiftright(F.col("block").cast("bigint"), bits).alias("cell"), histogram_bucket(F.col("total")).alias("bucket"), "ts", "total", "app")
    return of.groupBy("cell", "bucket").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("total") > 0).alias("filled"), F.sum("total").alias("total"), F.sum("app").alias("app"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).select(F.lit(0).alias("level"), "*")


def merged(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "bucket").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def pyramid(points: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """The cells of all levels. One pass: a cell of level 0 gives its sums to the cell above it at each level."""
    base = cells(points, bits)
    up = base.drop("level").select(F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "*")
    placed = up.withColumn("cell", F.expr("shiftright(cell, level)"))
    return merged(placed, "level", "cell").select(*base.columns)


def added(held: DataFrame, more: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """A pyramid with the points of blocks that it lacks."""
    return merged(held.unionByName(pyramid(more, bits, levels)), "level", "cell").select(*held.columns)


def cover(lo: int, hi: int, bits: int = BITS, levels: int = LEVELS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Cells (level, cell), and ranges of blocks, that make up lo <= block < hi together."""
    first, last = -(-lo >> bits), hi >> bits
    if first >= last:
        return [], [(lo, hi)] if lo < hi else []
    edges = [e for e in ((lo, first << bits), (last << bits, hi)) if e[0] < e[1]]
    out, level = [], 0
    while first < last:
        if first & 1 or level == levels - 1:
            out.append((level, first))
            first += 1
        if first < last and (last & 1) and level < levels - 1:
            last -= 1
            out.append((level, last))
        if level < levels - 1:
            first, last, level = first >> 1, last >> 1, level + 1
    return out, edges


def range_cells(points: DataFrame, held: DataFrame, lo: int, hi: int, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """The summaries that a range is made of: whole cells from the pyramid, edges from the points."""
    whole, edges = cover(lo, hi, bits, levels)
    inside, near = F.lit(False), F.lit(False)
    for level in sorted({k for k, _ in whole}):
        inside |= (F.col("level") == level) & F.col("cell").isin([c for k, c in whole if k == level])
    for a, b in edges:
        near |= (F.col("block") >= a) & (F.col("block") < b)
    return held.where(inside).unionByName(cells(points.where(near), bits))


def range_histogram(points: DataFrame, held: DataFrame, lo: int, hi: int, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """bucket, blocks over lo <= block < hi: what ``block_histogram`` gives for these points."""
    return range_cells(points, held, lo, hi, bits, levels).groupBy("bucket").agg(F.sum("blocks").alias("blocks"))


def range_cadence(points: DataFrame, held: DataFrame, lo: int, hi: int, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """One row of a range: blocks, filled ones, transactions, those of users, time between its ends."""
    return range_cells(points, held, lo, hi, bits, levels).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], (F.max("last_ts") - F.min("first_ts")).alias("time_span"))
