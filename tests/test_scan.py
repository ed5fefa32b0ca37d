"""Segmented scans against plain loops, and how one hot key's rows spread."""

import random

import pytest
from pyspark.sql import functions as F

from slotline.functions import u256
from slotline.operators import joins, scan, seq


def history(seed, n=400):
    """Rows k, pos, log, on, move: one key has nine tenths, another is null, positions leave gaps and go below zero."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 9 + ["cold", None]), rng.randint(-40, 300), i, rng.random() < 0.5, rng.choice([1, -1, 5])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    made = {seed: history(seed) for seed in (1, 2)}
    return {seed: (own, spark.createDataFrame(own, "k string, pos long, log long, on boolean, move long").repartition(3)) for seed, own in made.items()}


def by_key(own):
    out = {}
    for r in sorted(own, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("bits", [None, 2, 5, 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_segments_change_no_result(rows, seed, bits):
    own, df = rows[seed]
    spans, pairs, states = set(), set(), set()
    for k, events in by_key(own).items():
        start, stack, state = None, [], None
        for _, pos, log, on, _ in events:
            if on and start is None:
                start = (pos, log)
            elif not on and start is not None:
                spans.add((k, start, (pos, log)))
                start = None
            if on:
                stack.append(log)
            else:
                pairs.add((k, log, stack.pop() if stack else None))
            if log % 3 == 0:
                state = (log,) if log % 2 else (None,)
            else:
                states.add((k, log, state[0] if state else -1))
        if start is not None:
            spans.add((k, start, None))
    got = seq.member_intervals(df, ["k"], ["pos", "log"], F.col("on"), bits=bits).collect()
    assert {(r.k, tuple(r.from_pos), r.to_pos and tuple(r.to_pos)) for r in got} == spans and len(got) == len(spans)
    got = seq.lifo_pair(df, ["k"], ["pos", "log"], F.col("on"), ~F.col("on"), "log", bits=bits).collect()
    assert {(r.k, r.close_id, r.open_id) for r in got} == pairs and len(got) == len(pairs)
    placed = df.withColumn("pos", F.struct("pos", "log"))
    changes = placed.where("log % 3 = 0").select("k", F.col("pos").alias("from_pos"), F.when(F.col("log") % 2 == 1, F.col("log")).alias("state"))
    got = joins.as_of(placed.where("log % 3 <> 0").select("k", "pos", "log"), changes, ["k"], "pos", "state", bits=bits).collect()
    # a null state counts as a state, the one before the first change as none
    want = {(k, log, None if s == -1 else s) for k, log, s in states}
    assert {(r.k, r.log, r.state) for r in got} == want and len(got) == len(states)


@pytest.mark.parametrize("bits", [None, 2, 20])
def test_balances_carry_over_segments(spark, bits):
    rng = random.Random(4)
    moves = [("hot" if rng.random() < 0.8 else f"a{rng.randint(0, 3)}", f"b{rng.randint(0, 2)}", rng.randint(0, 200), rng.randint(0, 2**63 - 1)) for _ in range(300)]
    df = spark.createDataFrame(moves, "s string, r string, block long, n long").withColumn("u", u256.from_long(F.col("n")))
    got = seq.running_balance(df, "s", "r", "block", "u", bits=bits).withColumn("t", u256.to_string(F.col("balance"))).collect()
    want, held = {}, {}
    for s, r, block, n in sorted(moves, key=lambda m: m[2]):
        held[s], held[r] = held.get(s, 0) - n, held.get(r, 0) + n
        want[s, block], want[r, block] = held[s], held[r]
    assert {(r.address, r.block): int(r.t) for r in got} == want and len(got) == len(want)
    assert all(r.alarm == (int(r.t) < 0) for r in got)


def test_one_key_spreads_over_all_tasks(spark):
    df = spark.range(40_000).selectExpr("'one' AS k", "id AS pos", "id % 7 < 3 AS on", "id AS log")
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (seq.lifo_pair(df, ["k"], ["pos"], F.col("on"), ~F.col("on"), "log", bits=8), joins.as_of(df.select("k", "pos", "log"), df.where("log % 50 = 0").selectExpr("k", "pos AS from_pos", "on AS state"), ["k"], "pos", "state", bits=8)):
            shares = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
            assert len(shares) == 4 and max(shares) < 0.5 * sum(shares)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_segments_of_other_positions(spark):
    df = spark.sql("SELECT DATE'1970-01-05' AS d, TIMESTAMP_SECONDS(3000000) AS t, 'x' AS s, named_struct('a', -5L, 'b', 2L) AS p, 1 AS i")
    got = df.select(*[scan.segment(df, c, b).alias(f"{c}{b}") for c in df.columns for b in (1, None)]).first()
    assert got.asDict() == {"d1": 2, "dNone": 0, "t1": 3_000_000_000_000 >> 21, "tNone": 0, "s1": 0, "sNone": 0, "p1": -3, "pNone": 0, "i1": 0, "iNone": 0}


def spans_and_points(seed):
    rng = random.Random(seed)
    points = [(rng.choice(["hot"] * 8 + ["cold", None]), (rng.randint(-50, 400), rng.randint(0, 3)) if rng.random() > 0.02 else None, i) for i in range(500)]
    spans = []
    for i in range(120):
        lo = (rng.randint(-60, 400), rng.randint(0, 3))
        hi = None if rng.random() < 0.1 else (lo[0] + rng.choice([0, 0, 1, 5, 200, -3]), rng.randint(0, 3))
        spans.append((rng.choice(["hot"] * 4 + ["cold", "none", None]), lo if rng.random() > 0.02 else None, hi, f"s{i}"))
    return points, spans


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("bits", [2, 6, 20])
def test_sweep_join_equals_nested_loops(spark, bits, closed):
    points, spans = spans_and_points(3)
    at = "struct<block:long,log:long>"
    p, s = spark.createDataFrame(points, f"k string, pos {at}, id long"), spark.createDataFrame(spans, f"k string, from_pos {at}, to_pos {at}, name string")
    got = scan.sweep_join(p.repartition(3), s, ["k"], "pos", closed=closed, bits=bits, buckets=5)
    assert got.columns == ["k", "pos", "id", "from_pos", "to_pos", "name"]
    found = [(r.id, r.name) for r in got.collect()]
    held = lambda x, lo, hi: lo <= x and (hi is None or (x <= hi if closed else x < hi))
    want = {(i, name) for k, x, i in points for key, lo, hi, name in spans if k is not None and k == key and x and lo and held(x, lo, hi)}
    assert set(found) == want and len(found) == len(want)
    assert scan.sweep_join(p, s.limit(0), ["k"], "pos").collect() == [] == scan.sweep_join(p.limit(0), s, ["k"], "pos").collect()


def test_sweep_makes_no_pair_that_is_no_match(spark):
    """One key, spans that touch many ranges but few points: what reaches the tasks is counted."""
    p = spark.range(0, 20_000, 7).selectExpr("'one' AS k", "id AS pos", "id")
    s = spark.range(3_000).selectExpr("'one' AS k", "id * 6 AS from_pos", "id * 6 + 3 AS to_pos", "id AS name")
    got = scan.sweep_join(p, s, ["k"], "pos", bits=8)
    assert got.count() == sum(1 for x in range(0, 20_000, 7) if x < 18_000 and x % 6 < 3)


def test_positions_without_order_are_refused(spark):
    p = spark.sql("SELECT 'a' AS k, 'text' AS pos, 'a' AS from_pos, 'b' AS to_pos")
    with pytest.raises(ValueError, match="whole numbers"):
        scan.sweep_join(p, p.drop("pos"), ["k"], "pos")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("bits", [2, 20])
def test_a_union_of_spans_holds_the_same_positions(spark, bits, closed):
    points, spans = spans_and_points(5)
    spans = [(k, lo and lo[0], hi and hi[0], n) for k, lo, hi, n in spans] * 3 + [("cold", 390, None, "a"), ("cold", 395, None, "b")]
    got = scan.union_of(spark.createDataFrame(spans, "k string, lo long, hi long, name string").repartition(3), ["k"], "lo", "hi", closed, bits).collect()
    held = lambda own: {(k, x) for k, lo, hi in own for x in range(-60, 700) if k is not None and lo is not None and x >= lo and (hi is None or (x <= hi if closed else x < hi))}
    assert held(map(tuple, got)) == held(s[:3] for s in spans)
    # in one segment no two overlap
    assert bits == 2 or sum(len(held([tuple(r)])) for r in got) == len(held(map(tuple, got)))


def test_attribution_does_not_grow_with_the_roles_of_a_key(spark):
    """Each of 300 changes lies in all of 300 roles of its signer: one row a change leaves the look-up, none a pair."""
    changes = spark.range(300).selectExpr("id", "'x' AS asset_id", "id + 400 AS block", "'s' AS signer")
    sources = spark.createDataFrame([("x", "x")], "asset_id string, source string")
    roles = spark.range(300).selectExpr("'x' AS source", "'s' AS account", "id AS role", "id AS from_block", "id + 600 AS to_block")
    joined = []
    was = scan.sweep_join
    scan.sweep_join = lambda *args, **named: joined.append(args) or was(*args, **named)
    try:
        got = joins.signer_attribution(changes, sources, roles, None, ["id"]).collect()
    finally:
        scan.sweep_join = was
    assert len(got) == 300 and {r.signed_by for r in got} == {"ISSUER_KEY"} and not joined
    spans = joins.scan.union_of(roles, ["source", "account"], "from_block", "to_block", closed=True)
    assert [tuple(r) for r in spans.collect()] == [("x", "s", 0, 899)]


def test_a_sweep_gives_its_matches_in_pieces(spark):
    import numpy as np

    first, end = np.array([0, 5, 3, 0]), np.array([4, 5, 1, 9])
    parts = list(scan.matches(first, end, 4))
    assert max(len(span) for _, span in parts) == 4
    assert [(int(p), int(s)) for place, span in parts for p, s in zip(place, span)] == [(p, 0) for p in range(4)] + [(p, 3) for p in range(9)]
    p = spark.range(300).selectExpr("'one' AS k", "id AS pos", "id")
    s = spark.range(400).selectExpr("'one' AS k", "id % 5 AS from_pos", "300 AS to_pos", "id AS name")
    assert scan.sweep_join(p, s, ["k"], "pos").count() == 80 * sum(300 - k for k in range(5))


def test_equal_roles_stand_together_and_other_keys_stay_away(spark, tmp_path):
    o = F.col("id")
    points = spark.range(300).select(o.alias("k"), F.lit("s").alias("source"), F.lit("a").alias("account"), ((o * 37) % 1000).alias("block"))
    roles = spark.range(4000).select(F.lit("s").alias("source"), F.lit("a").alias("account"), ((o * 7919) % 20).alias("role"), F.lit(0).cast("bigint").alias("from_block"), F.when(o % 2 == 0, F.lit(499).cast("bigint")).alias("to_block"))
    other = spark.range(5000).select(o.alias("k"), F.lit("s").alias("source"), o.cast("string").alias("account"), o.alias("block"))
    joins.role_open_at(points.unionByName(other), roles, bits=6).select("k", "role", "from_block").write.parquet(f"{tmp_path}/rows")
    got = {(r.k, r.role): r["count"] for r in spark.read.parquet(f"{tmp_path}/rows").groupBy("k", "role").count().collect()}
    held = [(i * 7919 % 20, None if i % 2 else 499) for i in range(4000)]
    want = {}
    for k in range(300):
        for role, end in held:
            if end is None or k * 37 % 1000 <= end:
                want[k, role] = want.get((k, role), 0) + 1
    assert got == want
    # a role's copies are one run in a file, not a row beside each other role and point
    assert sum(f.stat().st_size for f in tmp_path.glob("rows/*.parquet")) < sum(want.values()) / 4
    assert scan.with_keys_of(points.unionByName(other), roles, ["source", "account"]).count() < 400
