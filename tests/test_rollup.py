"""Ranges from the pyramid against the points themselves."""

import random

import pytest
from pyspark.sql import functions as F

from slotline.operators import aggs, rollup


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(8)
    rows = [(b, 3 * b + rng.randint(0, 2), rng.choice([0, 0, 1, 5, 40, 300]), 0) for b in sorted(rng.sample(range(3_000), 1_800))]
    return spark.createDataFrame(rows, "block long, ts long, total long, app long").withColumn("app", F.col("total") - F.col("total") % 2).persist()


def test_random_ranges_equal_the_points(points):
    rng = random.Random(4)
    held = rollup.pyramid(points, 4, 6).persist()
    for lo, hi in [(0, 3_000), (17, 17), (5, 9), (16, 32), *[sorted((rng.randint(0, 3_100), rng.randint(0, 3_100))) for _ in range(8)]]:
        own = points.where((F.col("block") >= lo) & (F.col("block") < hi))
        got = rollup.range_histogram(points, held, lo, hi, 4, 6)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, aggs.block_histogram(own).collect()))
        want = own.agg(F.count("*"), F.count_if(F.col("total") > 0), F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("app"), F.lit(0)), F.max("ts") - F.min("ts")).first()
        assert tuple(rollup.range_cadence(points, held, lo, hi, 4, 6).first()) == tuple(want)


def test_a_pyramid_grows_by_new_blocks(points):
    whole = rollup.pyramid(points, 4, 6)
    grown = rollup.added(rollup.pyramid(points.where("block < 1234"), 4, 6), points.where("block >= 1234"), 4, 6)
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, whole.collect()))


def test_a_range_is_few_cells_and_short_edges():
    rng = random.Random(6)
    for _ in range(500):
        lo, hi = sorted((rng.randint(-100_000, 10_000_000), rng.randint(-100_000, 10_000_000)))
        whole, edges = rollup.cover(lo, hi)
        assert len(whole) <= 2 * 14 and sum(b - a for a, b in edges) < 2 << rollup.BITS
        spans = sorted([*edges, *((c << k + rollup.BITS, c + 1 << k + rollup.BITS) for k, c in whole)])
        assert not spans or (spans[0][0] == lo and spans[-1][1] == hi and all(x[1] == y[0] for x, y in zip(spans, spans[1:])))


def test_rows_read_do_not_grow_with_the_range(points):
    held = rollup.pyramid(points, 4, 8)
    few = rollup.range_cells(points, held, 1, 2_999, 4, 8).count()
    assert few <= 6 * (2 * 8 + 2) < points.count() / 10
