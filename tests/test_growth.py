"""What larger tables cost: no shuffle of all rows to one key, no pairs without need; results against plain loops."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from slotline.functions import registry
from slotline.operators import extract, search
from slotline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_decoding_shuffles_no_logs(spark):
    logs = spark.range(5).selectExpr("id", "'ARC_TOKEN' AS source_kind", "array('0x00') AS topics", "'0x' AS data")
    assert "Exchange hashpartitioning" not in plan(extract.decode_events(logs, registry.registry(spark)))


def test_one_asset_s_markets_spread(spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        import slotline.plans.more  # noqa: F401  registers the query

        own = QUERIES["resolve_sources"](spark, DATA).where("source_kind = 'MORPHO'")
        shares = own.groupBy("asset_id", F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    parts = {}
    for r in shares:
        parts.setdefault(r.asset_id, []).append(r["count"])
    assert max(len(p) for p in parts.values()) == 4


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[^a-z0-9]+", text.lower()) if w for i in range(len(w) + 1)}


@pytest.mark.parametrize("k", [1, 4])
def test_many_searches_equal_all_pairs(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 3))) for _ in range(150)] + ["same text"] * 10 + ["Text same"] * 9
    rows = [(rng.choice("xy"), f"k{i}", t, rng.choice([1, 2])) for i, t in enumerate(texts)]
    asked = [rng.choice(texts) for _ in range(25)] + ["same text", "zzz", "", "a", "a"]
    index = spark.createDataFrame(rows, "kind string, key string, text string, weight int")
    got = search.search_many(index, spark.createDataFrame([(q,) for q in asked], "query string"), k, 0.2).collect()
    want = set()
    for q in set(asked):
        near = [(len(grams(q) & grams(t)) / len(grams(q) | grams(t)), w, kind, key) for kind, key, t, w in rows if grams(q) | grams(t)]
        near = sorted((x for x in near if x[0] > 0.2), key=lambda x: (-x[0], -x[1], x[2], x[3]))
        want |= {(q, n + 1, kind, key, s) for n, (s, _, kind, key) in enumerate(near[:k])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    # texts of the same trigrams are one set, with its k best rows
    own = index.select(F.array_sort(search.trigrams(F.col("text"))).alias("set")).where(F.size("set") > 0)
    counts = own.distinct().select(F.explode("set").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    assert search.ranked_sets(own, counts, "d", "n").count() == len({frozenset(grams(t)) for t in texts if grams(t)})


def executed(lines, router):
    """Hook calls by a plain loop over the lines."""
    on, hook, took, out = False, None, {}, []
    for line in lines:
        r = line[8:] if line.startswith("Program ") else ""
        own = line.startswith("Program ") and r.startswith(router)
        if own and " invoke [" in r:
            on = True
        elif own and (r.endswith(" success") or " failed" in r):
            on, hook, took = False, None, {}
        elif on and " invoke [" in r:
            hook, took = r.split(" invoke [")[0], {}
        elif on and " consumed " in r:
            took["units"] = int(r.split(" consumed ")[1].split(" of ")[0])
        elif on and " failed:" in r:
            if hook is not None and r.split(" failed:")[0] == hook:
                out.append((took.get("to", hook), "reject", took.get("why", r.split(" failed:", 1)[1].strip()), took.get("units")))
                hook, took = None, {}
        elif on and line.startswith("Program log: Call: "):
            took["to"] = line.split(", to ")[1].lower()
        elif on and line.startswith("Program log: EVM callback reverted: "):
            took["why"] = line[36:].strip()
        elif on and line.startswith("Program log: Hook["):
            words = (line.split("result=")[1].split(" ", 1) + [""])[:2] if "result=" in line else ("unknown", "")
            if "to" in took or hook is not None:
                out.append((took.get("to", hook), words[0], words[1].strip() or took.get("why"), took.get("units")))
            took = {}
    return out


def logs_of(spark, kinds, seed, most):
    rng = random.Random(seed)
    logs = [[rng.choice(kinds) for _ in range(rng.randint(0, most))] for _ in range(200)]
    return logs, spark.createDataFrame(list(enumerate(logs)), "k int, lines array<string>")


def test_hooks_are_folded_in_their_row(spark):
    kinds = "Program R invoke [1]|Program R invoke [1]|Program R success|Program R failed: x|Program A invoke [2]|Program B invoke [2]|Program A failed: no: 1|Program B failed: two|Program A consumed 5 of 9|Program B consumed 7 of 9|Program log: Call: a, to 0xAB|Program log: Call: a, to 0xCD|Program log: EVM callback reverted: Why |Program log: Hook[0] result=pass|Program log: Hook[1] result=no  bad one|Program log: Hook[2]|other".split("|")
    logs, df = logs_of(spark, kinds, 5, 30)
    got = extract.hook_executions(df, ["k"], "R").orderBy("k", "idx").collect()
    want = [(k, *own, n + 1) for k, lines in enumerate(logs) for n, own in enumerate(executed(lines, "R"))]
    assert [(r.k, r.hook_address, r.result, r.reason, r.gas_used, r.idx) for r in got] == want and len(want) > 100
    for name in ("hook_executions", "hook_mismatch", "hook_invocations"):
        text = plan(QUERIES[name](spark, DATA))
        assert "Window" not in text and "Aggregate" not in text and text.count("Exchange hashpartitioning(k") == 1


def targeted(lines, plumbing):
    invoke, mark = re.compile(r"^Program (\S+) invoke \[(\d+)\]"), re.compile(r"^Program \S+ (invoke|success)")
    for k, line in enumerate(lines):
        hit = invoke.search(line)
        if hit and int(hit[2]) >= 2 and hit[1] not in plumbing:
            for n, x in enumerate(lines[k:]):
                if n and mark.search(x):
                    break
                if "Instruction: " in x:
                    return hit[1], x.split("Instruction: ")[1]
            return hit[1], None
    return None


def test_targets_are_read_in_their_row(spark):
    kinds = "Program A invoke [1]|Program X invoke [2]|Program B invoke [2]|Program C invoke [3]|Program B success|Program log: invoke|Program log: Instruction: Swap|Program log: Instruction: Pay|Program B failed: x|Program  invoke [2]|other".split("|")
    logs, df = logs_of(spark, kinds, 6, 12)
    want = {k: targeted(lines, ["X"]) for k, lines in enumerate(logs)}
    want = {k: v for k, v in want.items() if v}
    assert {r.k: (r.program, r.instruction) for r in extract.cpi_targets(df, ["X"]).collect()} == want and len(want) > 50
    apart = df.select("k", F.posexplode("lines").alias("line_no", "line"))
    assert {r.k: (r.program, r.instruction) for r in extract.cpi_target(apart, ["k"], ["X"]).collect()} == want
    assert "Window" not in plan(QUERIES["cpi_target"](spark, DATA))


def test_many_searches_broadcast_no_sets(spark):
    # files of sets are small, their rows in a broadcast are not
    assert "BroadcastExchange" not in plan(QUERIES["search_many"](spark, DATA))


def test_rows_of_many_megabytes_are_written_in_parts(spark, tmp_path):
    import pyarrow.parquet as pq

    import slotline.plans.more  # noqa: F401  registers the query

    keys = [f"parquet.{part}.size.row.check.min" for part in ("page", "block")]
    try:
        own = QUERIES["resolve_sources"](spark, DATA).where("source_kind = 'MORPHO'")
        assert "ShuffledHashJoin" not in plan(own)  # which would hold all ids that a task gets
        ids = F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.lpad(F.hex(F.col("id") * 100_000 + i), 64, "0"))
        spark.range(80, numPartitions=1).select(ids.alias("ids")).write.option("parquet.block.size", 4 << 20).parquet(f"{tmp_path}/rows")
    finally:
        for k in keys:
            spark.conf.unset(k)
    own = pq.ParquetFile(next(tmp_path.glob("rows/*.parquet"))).metadata
    assert own.num_rows == 80 and own.num_row_groups > 1
