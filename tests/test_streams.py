"""Merged tables, seen sets and rechecks on streams: replays, redelivery, and what a batch reads."""

import random

import pytest
from pyspark.sql import functions as F

from slotline.operators import merge
from slotline.sources.buckets import BucketedTable, by_hash, by_range
from slotline.streaming import streams

SHAPE = "k bigint, state string, n bigint"


def test_a_small_batch_reads_its_own_buckets(spark, tmp_path):
    rule = lambda old, new: merge.upsert_changed(old, new, ["k"], ["state", "n"])
    full = spark.range(6_400).selectExpr("id AS k", "'old' AS state", "id AS n")
    table = BucketedTable(spark, f"file://{tmp_path}/t", full.schema, by_range("k", 6))
    table.merge(full, 0, rule)
    batch = spark.range(6_336, 6_464).selectExpr("id AS k", "'new' AS state", "-id AS n")  # one old bucket, one new
    touched = table.touched(batch)
    assert touched == [99, 100]
    assert {f.split("bucket=")[1].split("/")[0] for f in table.read(touched, 1).inputFiles()} == {"99"}
    for _ in range(2):  # a replay changes nothing
        table.merge(batch, 1, rule)
        got = {r.k: (r.state, r.n) for r in table.read().collect()}
        assert got == {k: ("old", k) for k in range(6_336)} | {k: ("new", -k) for k in range(6_336, 6_464)}
    # buckets that the batch did not touch keep their first version
    assert {r.version for r in table.manifest().where("bucket < 99").collect()} == {0}
    assert table.read(before=1).count() == 6_400 and table.read(before=0).count() == 0


def test_a_merge_writes_a_file_a_bucket(spark, tmp_path):
    full = spark.range(6_400).selectExpr("id AS k", "'old' AS state", "id AS n").repartition(4)
    table = BucketedTable(spark, f"file://{tmp_path}/t", full.schema, by_range("k", 6))
    table.write(full, table.touched(full), 0)
    assert len(table.read().inputFiles()) == 100 and table.read().count() == 6_400


def test_merges_equal_one_upsert(spark, tmp_path):
    rng = random.Random(2)
    rows = [[(rng.randint(-30, 60), rng.choice("abc"), rng.choice([None, 1, 2])) for _ in range(40)] for _ in range(4)]
    rows = [list({r[0]: r for r in own}.values()) for own in rows]
    want = spark.createDataFrame([], SHAPE)
    rules = {"state": "replace", "n": "fill"}
    for number, own in enumerate(rows):
        batch = spark.createDataFrame(own, SHAPE)
        for bucket, name in ((by_range("k", 3), "range"), (by_hash(["k"], 5), "hash")):
            streams.merge_into(f"file://{tmp_path}/{name}", batch.schema, bucket, lambda old, new: merge.upsert_merge(old, new, ["k"], rules))(batch, number)
        want = spark.createDataFrame(merge.upsert_merge(want, batch, ["k"], rules).collect(), SHAPE)
    for bucket, name in ((by_range("k", 3), "range"), (by_hash(["k"], 5), "hash")):
        assert sorted(map(tuple, streams.merged(spark, f"file://{tmp_path}/{name}", want.schema, bucket).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_address_stats_count_a_transaction_once(spark, tmp_path):
    shape = "tx string, at bigint, a string, b string"
    batches = [
        [("t1", 5, "x", "y"), ("t2", 6, "x", "x"), ("t2", 6, "x", "x"), ("t3", 900, None, "y")],
        [("t1", 5, "x", "y"), ("t4", 901, "x", "z")],  # t1 comes again
        [],
        [("t5", 5, "y", None)],
    ]
    apply = streams.address_stats_into(f"file://{tmp_path}/s", "tx", "at", ["a", "b"], bits=4)
    for number in (0, 1, 1, 2, 3, 3):  # batches 1 and 3 run twice
        apply(spark.createDataFrame(batches[number], shape), number)
    got = {r.address: (r.txs, r.first_seen, r.last_seen) for r in streams.address_stats_of(spark, f"file://{tmp_path}/s").collect()}
    assert got == {"x": (3, 5, 901), "y": (3, 5, 900), "z": (1, 901, 901)}
    # batch 3 touched one range of positions and read that one's file alone
    table = BucketedTable(spark, f"file://{tmp_path}/s/seen", spark.createDataFrame([], "key string, at bigint, address string").schema, by_range("at", 4))
    assert {f.split("bucket=")[1].split("/")[0] for f in table.read([0], 3).inputFiles()} == {"0"}
    assert sorted(r.bucket for r in table.manifest().collect()) == [0, 56]


def push(spark, path, rows, shape, number):
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{path}/part={number}")


@pytest.fixture
def rechecked(spark, tmp_path):
    """Feeds rows and late inputs trigger by trigger; returns what each trigger gave and the state's rows after it."""

    def run(steps, n, disorder=0):
        out, kept = [], []
        for name in ("feed", "late"):
            spark.createDataFrame([], "k bigint, pos bigint").write.parquet(f"{tmp_path}/{name}/part=-1")
        source = lambda name: spark.readStream.schema("k bigint, pos bigint").parquet(f"{tmp_path}/{name}/part=*")
        found = streams.recheck_stream(source("feed"), source("late").withColumnRenamed("pos", "seen"), ["k"], "pos", "seen", n, disorder)
        query = found.writeStream.foreachBatch(lambda b, i: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            given = []
            for number, (feed, late) in enumerate(steps):
                push(spark, f"{tmp_path}/feed", feed, "k bigint, pos bigint", number)
                push(spark, f"{tmp_path}/late", late, "k bigint, pos bigint", number)
                query.processAllAvailable()
                given.append(sorted(out))
                out.clear()
                kept.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
        finally:
            query.stop()
        return given, kept

    return run


def test_late_inputs_settle_open_rows_and_old_ones_expire(rechecked):
    steps = [
        ([(1, 10), (2, 11)], [(9, 10)]),
        ([(3, 20)], [(1, 15)]),  # 1 is settled within its 10 positions
        ([(4, 100)], [(2, 100)]),  # 2 comes too late
        ([(5, 200)], [(4, 105)]),  # 4 in time, though a later row came with it
        ([(6, 400)], [(7, 400)]),
        ([(8, 600)], [(7, 600)]),
    ]
    given, kept = rechecked(steps, 10, disorder=100)
    settled = {r[0]: r[2] for rows in given for r in rows}
    assert settled[1] and settled[4] and settled[2] is False and settled[3] is False
    assert len([r for rows in given for r in rows]) == len(settled)
    assert max(kept) < 20


def test_state_is_bounded_by_the_window(rechecked):
    steps = [([(100 * t + i, 100 * t + i) for i in range(100)], [(100 * t + i, 100 * t + i + 3) for i in range(0, 100, 2)]) for t in range(6)]
    given, kept = rechecked(steps, 5, disorder=0)
    settled = {r[0]: r[2] for rows in given for r in rows}
    assert all(settled[k] for k in settled if k % 2 == 0) and not any(settled[k] for k in settled if k % 2)
    assert kept[-1] <= kept[2] + 60  # it does not grow with what was read


def test_a_backlog_is_read_in_steps(spark, monkeypatch):
    import slotline.plans.more as more
    from slotline.plans.queries import QUERIES

    monkeypatch.setattr(streams, "STEP", 20_000)
    seen, save = [], more.scratch
    monkeypatch.setattr(more, "scratch", lambda s: seen.append(save(s)) or seen[-1])
    d = "/root/testdata/sf0.01"
    got = {r.o_orderkey: r.resolved for r in QUERIES["stream_recheck"](spark, d).collect()}
    orders, lines = more.table(spark, d, "orders"), more.table(spark, d, "lineitem")
    tip, late = orders.agg(F.max("o_orderkey")).first()[0], {}
    for r in lines.collect():
        late.setdefault(r.l_orderkey, []).append(r.l_partkey % 900)
    assert got == {r.o_orderkey: min(late.get(r.o_orderkey, [900])) <= 500 for r in orders.collect() if r.o_orderstatus != "F" and r.o_orderkey < tip - 3000}
    steps = spark.read.parquet(f"{seen[0]}/steps/late").groupBy("step").count().collect()
    assert len(steps) > 1 and max(r["count"] for r in steps) < 25_000


def test_a_session_ends_after_exactly_the_gap(spark, tmp_path):
    day = 86_400
    rows = [("a", 0), ("a", day), ("a", 2 * day - 1), ("b", 5), ("b", day + 4), ("b", 2 * day + 5)]
    spark.createDataFrame(rows, "k string, at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    own = spark.readStream.schema("k string, at long").parquet(f"{tmp_path}/in").select("k", F.timestamp_seconds("at").alias("ts"))
    counted, out = streams.session_counts(own, "ts", "1 day", "1 day", ["k"]), []
    shown = counted.select("k", F.unix_timestamp("session.start").alias("start"), F.unix_timestamp("session.end").alias("end"), "n")
    shown.writeStream.outputMode("complete").foreachBatch(lambda b, i: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [("a", 0, day, 1), ("a", day, 3 * day - 1, 2), ("b", 5, 2 * day + 4, 2), ("b", 2 * day + 5, 3 * day + 5, 1)]


def test_pairs_are_rechecked_as_in_the_stream_and_little_is_handed_on(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, i) for i in range(0, 4000, 2)]
    late = [(i, i + rng.randint(0, 40)) for i in rng.sample(range(4000), 1500)] + [(0, 3), (0, 3)]
    for name, own in (("feed", rows), ("late", late)):
        for step in range(8):
            push(spark, f"{tmp_path}/{name}", [r for r in own if step * 500 <= r[1] < step * 500 + 500], "k bigint, at bigint", step)
    assert streams.in_order(spark, f"{tmp_path}/none")  # no file is in order
    source = lambda name: spark.readStream.schema("k bigint, at bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/part=*").withColumn("_late", F.lit(name == "late"))
    apply = streams.recheck_pairs_into(f"{tmp_path}/found", ["k"], "at", 20)
    twice = lambda batch, number: [apply(batch, number) for _ in range(2)]  # noqa: E731  a replay changes nothing
    streams.run_available(source("feed").unionByName(source("late")), twice, f"{tmp_path}/cp").awaitTermination()
    found = spark.read.schema("k bigint, at bigint, resolved boolean, batch int, open boolean").parquet(f"{tmp_path}/found/rows")
    got = [(r.k, r.resolved) for r in found.where("NOT open").collect()]
    near = {k for k, seen in late if k <= seen <= k + 20}
    assert len(got) == len(dict(got)) and all(was == (k in near) for k, was in got) and {k for k, _ in rows if k < 3900} <= {k for k, _ in got}
    assert max(r["count"] for r in found.where("open").groupBy("batch").count().collect()) < 30
    assert spark.read.parquet(f"{tmp_path}/found/seen").groupBy("batch").count().agg(F.max("count")).first()[0] < 30
