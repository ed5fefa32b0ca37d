import random

import duckdb
import pytest
from pyspark.sql import functions as F

from slotline.functions import hexabi, u256
from slotline.operators import extract, joins, reconcile, seq, upkeep
from slotline.plans.queries import QUERIES, SQL
from slotline.streaming import streams

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({SQL[name]})").fetchall()
    got = df.select(*cols).collect()
    assert sorted(map(repr, map(plain, map(tuple, got)))) == sorted(map(repr, map(plain, want)))


def test_u256_equals_integers(spark):
    rng = random.Random(1)
    words = [rng.getrandbits(256) for _ in range(50)] + [0, 1, 2**256 - 1, 2**128]
    df = spark.createDataFrame([(k, f"0x{w:064x}") for k, w in enumerate(words)], "k int, h string").withColumn("u", u256.from_hex(F.col("h")))
    assert [int(r[0]) for r in df.orderBy("k").select(u256.to_string(F.col("u"))).collect()] == words
    signed = df.withColumn("u", F.when(F.col("k") % 2 == 0, F.col("u")).otherwise(u256.negate(F.col("u"))))
    total = signed.agg(u256.normalise(u256.sum_of(F.col("u"))).alias("u")).select(u256.to_string(F.col("u"))).first()[0]
    assert int(total) == sum(w if k % 2 == 0 else -w for k, w in enumerate(words))


def test_lifo_equals_stack(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.choice("oc")) for g in range(40) for k in range(30)]
    df = spark.createDataFrame(rows, "g int, k int, t string")
    got = {(r.g, r.close_id): r.open_id for r in seq.lifo_pair(df, ["g"], ["k"], F.col("t") == "o", F.col("t") == "c", "k").collect()}
    want, stack, last = {}, [], None
    for g, k, t in rows:
        stack, last = ([] if g != last else stack), g
        if t == "o":
            stack.append(k)
        else:
            want[g, k] = stack.pop() if stack else None
    assert got == want


def test_labels_and_addresses(spark):
    rows = [("Compound cached 9-asset", "cwUSDC-9", ""), ("", "wUSDC", ""), ("", "", ""), ("", "", "0x6080128acb08")]
    label, detail = hexabi.normalize_label(F.col("n"), F.col("s"), F.col("c"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "n string, s string, c string").select(label, detail).collect()]
    assert got == [("Compound", "cwUSDC-9"), ("wUSDC", None), (None, None), ("Uniswap V3", None)]
    text = "0x" + f"{32:064x}{5:064x}" + b"hello".hex().ljust(64, "0")
    one = spark.createDataFrame([(text, "0x" + "0" * 24 + "ab" * 20)], "d string, t string").select(hexabi.abi_string(F.col("d")), hexabi.topic_to_address(F.col("t"), True), hexabi.topic_to_address(F.lit("0x12"))).first()
    assert tuple(one) == ("hello", "0x" + "ab" * 20, "")


def test_log_lines(spark):
    lines = ["Program A invoke [1]", "Program B invoke [2]", "Program log: Instruction: Swap", "Program B success", "Program A success"]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "sig string, line_no int, line string")
    assert extract.top_level_programs(extract.parse_invokes(df, ["sig"]), ["sig"]).first().programs == ["A"]
    assert tuple(extract.cpi_target(df, ["sig"], ["X"]).first()) == ("s", "B", "Swap")


def test_range_join_gaps_and_plan(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 10, None)], "k string, from_pos int, to_pos int")
    points = spark.createDataFrame([("a", 9), ("a", 10), ("b", 1)], "k string, pos int")
    assert sorted((r.pos, r.from_pos) for r in joins.in_interval(points, spans, ["k"], "pos").collect()) == [(9, 0), (10, 10)]
    gaps = spark.createDataFrame([("x", 5, 6), ("y", 90, 99)], "address string, from_block int, to_block int")
    blocks = spark.createDataFrame([(5, 50), (6, 61)], "block int, slot int")
    assert {r.address: r.status for r in reconcile.gap_plan(gaps, blocks, 10).collect()} == {"x": "open", "y": "done"}


def test_closure_stops(spark):
    edges = spark.createDataFrame([("t", "p"), ("p", "q"), ("q", "z")], "a string, b string")
    got = joins.pair_closure(edges, spark.createDataFrame([("p",), ("q",)], "address string"), spark.createDataFrame([("t",)], "address string"))
    assert sorted(r.address for r in got.collect()) == ["p", "q", "t"]


def test_stream_mirror_is_exactly_once(spark, tmp_path):
    schema = "k long, v string"
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.run_available(stream, streams.mirror_into(f"{tmp_path}/out", ["k"]), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_stream_windows(spark, tmp_path):
    spark.range(10).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("x").alias("k")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.file_stream(spark, f"{tmp_path}/in", "ts timestamp, k string")
    q = streams.windowed_counts(stream, "ts", "1 minute", "5 minutes", None, ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [5, 5]


def test_text_forms(spark):
    words = ["0" * 64, "00" * 3 + "ab" * 29, "f" * 64, "zz" * 32, None]
    got = [r[0] for r in spark.createDataFrame([(k, None if w is None else "0x" + w) for k, w in enumerate(words)], "k int, h string").orderBy("k").select(hexabi.bytes32_to_base58(F.col("h"))).collect()]
    assert got[0] == "1" * 32 and got[3:] == [None, None]
    for w, text in zip(words[1:3], got[1:3]):
        n = 0
        for c in text:
            n = n * 58 + hexabi.BASE58.index(c)
        assert n == int(w, 16) and len(text) - len(text.lstrip("1")) == (64 - len(w.lstrip("0"))) // 2
    texts = ["0", "7", "007", "-1", "1.0", "", "1\n", None, str(2**256 - 1), str(2**256)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(u256.to_string(u256.from_string(F.col("t"))))
    assert [r[0] for r in rows.collect()] == ["0", "7", None, None, None, None, None, None, str(2**256 - 1), None]
    legs = '[{"solChain":"m","solSignature":"s"},{"solChain":"m"},3,"x"]'
    rows = spark.createDataFrame([(0, legs), (1, "{}"), (2, "no"), (3, None)], "k int, t string").orderBy("k").select(hexabi.legs_parse(F.col("t")))
    assert [[tuple(x) for x in r[0]] for r in rows.collect()] == [[("m", "s")], [], [], []]


def test_config_check(spark):
    assets = spark.createDataFrame([("a",), ("b",)], "router string")
    upkeep.config_check(assets, assets, "router")
    with pytest.raises(ValueError, match="b"):
        upkeep.config_check(assets, assets.where("router = 'a'"), "router")


def test_record_stream_equals_full_build(spark, tmp_path):
    rng = random.Random(3)
    rows = [(b, b * 30, n := rng.randrange(50), rng.randrange(n + 1)) for b in range(90)]
    schema = "block long, ts long, total long, app long"
    for n in range(3):
        spark.createDataFrame(rows[30 * n : 30 * n + 30], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.run_available(stream, streams.record_into(f"{tmp_path}/out", 5, 4, 60), f"{tmp_path}/cp").awaitTermination()
    record = spark.read.parquet(f"{tmp_path}/out/record/batch=2")
    full = seq.sliding_windows(spark.createDataFrame(rows, schema), 4, 60)
    assert seq.topk_disjoint(record, 5, 4).collect() == seq.topk_disjoint(full, 5, 4).collect()


def test_late_and_touched_streams(spark, tmp_path):
    feed = spark.createDataFrame([(1, "a", False), (8, "a", False), (9, "b", True), (10, "c", False)], "pos int, k string, done boolean")
    late = spark.createDataFrame([("a",), ("b",)], "k string")
    streams.recheck_into(f"{tmp_path}/late", lambda: feed, ["k"], "pos", 5, "done")(late, 0)
    assert [r.pos for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [8]
    streams.recompute_into(f"{tmp_path}/stats", lambda: feed, ["k"], lambda x: x.groupBy("k").count())(late, 0)
    assert {r.k: r["count"] for r in spark.read.parquet(f"{tmp_path}/stats").collect()} == {"a": 2, "b": 1}
    streams.announce_into(f"{tmp_path}/told", ["k"], "pos", "k", "done")(feed, 0)
    assert spark.read.parquet(f"{tmp_path}/told").count() == 3


def test_registry_is_whole():
    from slotline.functions.registry import descriptors

    rows = descriptors()
    assert len(rows) == 87 and len({(kind, topic) for kind, topic, *_ in rows}) == 87
    assert all(len(topic) == 66 and args for _, topic, _, _, args in rows)


def test_rebuild_is_the_same_in_any_order(spark):
    from slotline.operators import audit
    from slotline.plans.chain import audit_events, hx

    assets = spark.range(10).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("asset_id"), hx(F.col("id") + 1000, 40).alias("token"), hx(F.col("id") + 2000, 40).alias("module"), hx(F.lit(3000), 40).alias("router"), F.lit(None).cast("string").alias("factory"), F.lit(None).cast("string").alias("storefront"))
    none, one = spark.createDataFrame([], "asset_id string, address string"), spark.range(1)
    config = audit.Config(assets, none, none, none, one.select(hx(F.lit(5000), 40).alias("address")), one.select(hx(F.lit(3000), 40).alias("router")), "t")
    events = audit_events(spark, DATA)
    first, second = audit.rebuild_all(events, config), audit.rebuild_all(events.orderBy(F.rand(3)).repartition(3), config)
    assert len(first) == 14
    for name in ("gate_interval", "exposure_window", "transfer_screening", "holder_balance"):
        assert sorted(map(repr, first[name].collect())) == sorted(map(repr, second[name].collect())) != []
    with pytest.raises(ValueError, match="no configuration"):
        audit.rebuild_all(events, audit.Config(assets, none, none, none, none.select("address"), none.select(F.col("address").alias("router")), "t"))


def test_rebuild_of_sales_yields_roles_and_changes(spark):
    from slotline.operators import audit

    rows, n = [], 0

    def log(source, kind, name, block, signer=None, **args):
        nonlocal n
        n += 1
        rows.append((n, source, kind, name, block, 0, n, signer, args))

    u = lambda x: f"0x{x:064x}"
    log("tok", "ARC_TOKEN", "RoleGranted", 1, role="admin", account="alice")
    log("tok", "ARC_TOKEN", "Upgraded", 2, "alice", implementation="i1")
    log("fac", "FACTORY", "TokenUpgraded", 3, "msig", token="tok", newImplementation="i2")
    log("fac", "FACTORY", "TokenUpgraded", 3, "bob", token="other", newImplementation="i9")
    log("tok", "ARC_TOKEN", "RoleRevoked", 4, role="admin", account="alice")
    log("tok", "ARC_TOKEN", "Upgraded", 4, "alice", implementation="i3")  # the role's last block counts
    log("tok", "ARC_TOKEN", "Upgraded", 5, "alice", implementation="i4")
    log("tok", "ARC_TOKEN", "Transfer", 6, **{"from": "shop", "to": "carl", "value": u(5)})
    log("usd", "PURCHASE_TOKEN", "Transfer", 6, **{"from": "carl", "to": "shop", "value": u(50)})
    log("shop", "STOREFRONT", "PurchaseMade", 6, buyer="carl", tokenContract="tok", amount=u(5))  # no price: takes nothing
    log("shop", "STOREFRONT", "PurchaseMade", 6, buyer="carl", tokenContract="tok", amount=u(5), pricePaid=u(50))
    log("shop", "STOREFRONT", "PurchaseMade", 7, buyer="dan", tokenContract="tok", amount=u(1), pricePaid=u(2))
    big = 2**200
    log("yld", "YIELD_TOKEN", "Transfer", 8, **{"from": "tok", "to": "carl", "value": u(big)})
    log("yld", "YIELD_TOKEN", "Transfer", 8, **{"from": "else", "to": "carl", "value": u(9)})
    log("tok", "ARC_TOKEN", "YieldDistributed", 9, amount=u(big - 1), token="yld")
    log("tok", "ARC_TOKEN", "YieldDistributed", 10, token="yld")
    log("yld", "YIELD_TOKEN", "Transfer", 11, **{"from": "tok", "to": "dan", "value": u(4)})
    events = spark.createDataFrame(rows, "event_id long, source string, source_kind string, event_name string, block long, tx int, log long, signer string, args map<string,string>")
    assets = spark.createDataFrame([("A", "tok", "mod", None, "fac", "shop")], "asset_id string, token string, module string, router string, factory string, storefront string")
    pairs = lambda *x: spark.createDataFrame(list(x), "asset_id string, address string")
    out = audit.rebuild_all(events, audit.Config(assets, pairs(), pairs(("A", "yld")), pairs(("A", "usd")), pairs().select("address"), pairs().select(F.col("address").alias("router")), "t", "msig"))
    assert sorted((r.block, r.before, r.after, r.signed_by) for r in out["code_change"].collect()) == [(2, None, "i1", "ISSUER_KEY"), (3, "i1", "i2", "MULTISIG"), (4, "i2", "i3", "ISSUER_KEY"), (5, "i3", "i4", "UNKNOWN")]
    assert sorted((r.block, r.purchase_event, r.token_leg, r.payment_leg) for r in out["sale"].collect()) == [(6, 11, 8, 9), (7, 12, None, None)]
    runs = out["yield_run"].withColumns({c: u256.to_string(F.col(c)) for c in ("credited", "stated", "remainder")}).orderBy("run").collect()
    assert [(r.run, r.credits, r.credited, r.stated, r.remainder, r.over_credit, r.closed) for r in runs] == [(0, 1, str(big), str(big - 1), "-1", True, True), (1, 0, "0", None, None, False, True), (2, 1, "4", None, None, False, False)]
    assert sorted((r.run, r.holder) for r in out["yield_credit"].collect()) == [(0, "carl"), (2, "dan")]
    assert [(r.role, r.account, r.from_pos.block, r.to_pos.block) for r in out["role_interval"].collect()] == [("admin", "alice", 1, 4)]


def test_lists_refuse_what_they_do_not_know(spark):
    from slotline.operators import pages

    df = spark.createDataFrame([("a", "SPL", None), ("b", None, "f"), ("c", "SPL", "f")], "address string, kind string, factory string")
    assert [r.address for r in pages.list_page("tokens", df, 5, kind="SPL", factory="f").collect()] == ["c"]
    for bad in ({"kind": "ERC-721"}, {"color": "red"}):
        with pytest.raises(ValueError):
            pages.list_page("tokens", df, 5, **bad)
    for name, own in pages.LISTS.items():  # every list pages over its own columns
        empty = spark.createDataFrame([], ", ".join(f"`{c}` {'array<string>' if c in own.members else 'string'}" for c in dict.fromkeys([*own.order, *own.filters, *own.members, *own.text, *(["is_oracle"] if own.hides_oracle else [])])).replace("is_oracle` string", "is_oracle` boolean"))
        assert pages.list_page(name, empty, 3).columns[-1] == "has_more"
