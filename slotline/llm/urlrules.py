"""URL filters by sort-merge range join (operator 10).

A host with its labels reversed and closed by a dot is a prefix of every host below it, so a rule's host covers one
interval of the sorted page keys and intervals of two rules are nested or apart. Pages are dealt out by ranges of
(reversed host, path), a rule goes to each range its interval meets, and each range is swept once in key order: the
stack holds the rules whose interval covers the page at hand, and the longest one whose path starts the page's path wins.
Ranges split a hot host by its paths, and a key that alone fills several ranges (rows without url, too) is dealt over as
many salts. Range limits come from a sample of about ``SAMPLE`` rows a range, taken by hash, and steer the load only.

Defined results: a url that is null or has no "://" has empty host and path and gets the default verdict; repeated rows
give a row each; with no rules all rows get the default; of equally long rules the longer host wins, then "block";
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, trimmed

#: (verdict, host, path) of the production rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"
SAMPLE, ROWS_PER_RANGE = 32, 500_000
CEILING = "\U0010ffff"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path."""
    inside = F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(inside, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def reversed_host(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(rows: Iterator[tuple[str, str, int, str, str]]) -> Iterator[str | None]:
    """The rule of each page in (key, path, is_page, rule path, rule) rows sorted by range, key and is_page."""
    stack: list[tuple[str, list[tuple[str, str]]]] = []
    for key, path, is_page, rule_path, rule in rows:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if not is_page:
            if not stack or stack[-1][0] != key:
                stack.append((key, []))
            stack[-1][1].append((rule_path, rule))
        else:
            fits = [(len(r), len(k), r) for k, own in stack for p, r in own if path.startswith(p)]
            yield max(fits)[2] if fits else None


def range_limits(sample: list[tuple[str, str, int]], ranges: int) -> tuple[list[tuple[str, str]], list[int]]:
    """Sorted limits of about ``ranges`` even ranges of weighed (key, path) pairs, and the number of the first part of each
    range and of the end: one part a range, more where one pair is as heavy as several ranges."""
    total, seen, limits, times = sum(n for *_, n in sample), 0, [], []
    for key, path, n in sorted(sample):
        crossed = (seen + n) * ranges // total - seen * ranges // total
        seen += n
        if crossed and seen < total or crossed > 1:
            limits.append((key, path))
            times.append(crossed)
    first = [0, 1]
    for k in times:
        first.append(first[-1] + k)
    return limits, first


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """page id, host, path, rule, verdict. ``rules``: verdict, host, path."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col).cast("string"))
    own = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    kind = own.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_rows = pages.count()
    ranges = max(parts, -(-n_rows // ROWS_PER_RANGE))
    row = F.xxhash64(id_col, "key", "path")
    sampled = own.where(F.pmod(row, F.lit(max(1, n_rows // (SAMPLE * ranges)))) == 0).groupBy("key", "path").count()
    limits, first_part = range_limits([tuple(r) for r in sampled.collect()], ranges)

    def deal_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(limits, x) for x in zip(b.column("key").to_pylist(), b.column("path").to_pylist())]
            part = [first_part[k] + h % (first_part[k + 1] - first_part[k]) for k, h in zip(at, b.column("row").to_pylist())]
            none = pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column("key"), pa.array([1] * len(at), pa.int32()), b.column("path"), b.column("host"), b.column(0), none], ["part", "key", "is_page", "path", "host", id_col, "rule"])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, key, p, rule) for key, p, rule in zip(*(b.column(c).to_pylist() for c in ("key", "path", "rule"))) for k in range(first_part[bisect_left(limits, (key, ""))], first_part[bisect_right(limits, (key + CEILING, "")) + 1])]
            cols = [pa.array([r[j] for r in rows], t) for j, t in ((0, pa.int32()), (1, pa.string()), (2, pa.string()), (3, pa.string()))]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([cols[0], cols[1], pa.array([0] * n, pa.int32()), cols[2], pa.nulls(n, pa.string()), pa.nulls(n, b.schema.field("id").type), cols[3]], ["part", "key", "is_page", "path", "host", id_col, "rule"])

    schema = f"part int, key string, is_page int, path string, host string, `{id_col}` {kind}, rule string"
    rows = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    table = rows.select(reversed_host(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), F.lit(None).cast(kind).alias("id"))
    both = own.withColumn("row", row).mapInArrow(trimmed(deal_pages), schema).unionByName(table.mapInArrow(trimmed(deal_rules), schema))
    dealt = both.repartition(ranges, "part").sortWithinPartitions("part", "key", "is_page", "path")

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def rows() -> Iterator[tuple[str, str, int, str, str]]:
            for b in batches:
                waiting.append(b)
                keep = b.column("is_page").to_pylist()
                prefix = [f"{p}\n" for p in b.column("part").to_pylist()]
                paths = b.column("path").to_pylist()
                for p, key, page, path, rule in zip(prefix, b.column("key").to_pylist(), keep, paths, b.column("rule").to_pylist()):
                    yield p + key, path, page, path, rule

        found: list[str | None] = []
        for rule in sweep(rows()):
            found.append(rule)
            if len(waiting) > 1:
                b = waiting.pop(0)
                b = b.filter(pa.array([x == 1 for x in b.column("is_page").to_pylist()]))
                head, found = found[: b.num_rows], found[b.num_rows :]
                yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("host"), b.column("path"), pa.array(head, pa.string())], [id_col, "host", "path", "rule"])
        for b in waiting:
            b = b.filter(pa.array([x == 1 for x in b.column("is_page").to_pylist()]))
            head, found = found[: b.num_rows], found[b.num_rows :]
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("host"), b.column("path"), pa.array(head, pa.string())], [id_col, "host", "path", "rule"])

    judged = dealt.mapInArrow(trimmed(swept), f"`{id_col}` {kind}, host string, path string, rule string")
    verdicts = rows.select(F.concat("host", "path").alias("rule"), "verdict").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    return judged.join(verdicts, "rule", "left").select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
r(rv, rh, rp) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + r"""),
m AS (SELECT p.*, r.* FROM p LEFT JOIN r ON ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM m
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) = 1
"""
