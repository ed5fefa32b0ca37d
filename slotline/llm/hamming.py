"""Exact top-k by Hamming distance with incremental multi-index hashing (operator 4).

A code is cut into segments, each an index of its own whose buckets are the segment's values. Round r looks up segment
values at distance r; after it every code within ``segments * (r + 1) - 1`` has been met. Rows found so far bound a query's
k-th distance: a round looks only into as many segments as reach that bound, and a query closes once it is reached.
Segments are short enough that a bucket holds about ``BUCKET`` codes: a query sends one row to a bucket, where its distances
to all codes are taken at once, and gets the k best back; buckets of many codes are cut into pieces. Equal codes are one
entry that keeps its k smallest ids, so a hot vector is one entry and no pairs within it arise; equal query codes are
searched once.

Defined results: a null or empty embedding has no code and neither asks nor answers; null and NaN elements give bit 0;
ties go to the smaller id; repeated rows are neighbours of their own; fewer than k rows give what there is; an embedding
of more than 64 numbers is an error; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucketed, materialize, read, release

BITS, K = 64, 10
#: Codes of a bucket, about; codes of a piece of a bucket; distances held at once.
BUCKET, PIECE, AT_ONCE = 1 << 10, 1 << 12, 1 << 20


def sign_code(vector: Column) -> Column:
    """Bit i is set where element i is above 0."""
    bits = F.transform(F.sequence(F.lit(0), F.size(vector) - 1), lambda i: F.when((F.get(vector, i) > 0) & ~F.isnan(F.get(vector, i)), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    packed = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit("codes hold 64 bits"))).when(F.size(vector) > 0, packed)


def segments_for(n: int) -> list[tuple[int, int]]:
    """(shift, bits) of segments of about log2(n / BUCKET) bits, 8 at least, so that a segment value is shared by about BUCKET entries."""
    m = max(2, round(BITS / max(8, math.log2(max(n, 1) / BUCKET))))
    edges = [round(BITS * k / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def bucket_of(code: Column, cuts: list[tuple[int, int]], flip: Column) -> Column:
    """Number of the bucket of segment ``j`` of a code with the bits of ``flip`` changed there."""
    shift, ones = (F.element_at(F.array(*map(F.lit, x)), F.col("j") + 1) for x in ([s for s, _ in cuts], [(1 << b) - 1 for _, b in cuts]))
    value = F.call_function("shiftrightunsigned", code, shift).bitwiseAND(ones.cast("bigint"))
    return F.col("j").cast("bigint") * (1 << max(b for _, b in cuts)) + value.bitwiseXOR(flip)


def masks(bits: int, r: int) -> Column:
    """All ways to flip r of the bits; their number depends on the two arguments alone."""
    text = ",".join(str(sum(1 << i for i in c)) for c in combinations(range(bits), r))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def buckets(entries: DataFrame, cuts: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """One row a piece of a bucket: key, and its codes, in order of their first ids, with these ids and their numbers of ids;
    and bucket, pieces of the buckets of more than PIECE codes. The key of piece p is the bucket plus p times the number of buckets."""
    own = entries.select("code", F.element_at("ids", 1).alias("id"), F.size("ids").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))).alias("j"))
    own = own.select("code", "id", "n", bucket_of(F.col("code"), cuts, F.lit(0)).alias("bucket"))
    crowded = materialize(own.groupBy("bucket").count().where(F.col("count") > PIECE).select("bucket", F.ceil(F.col("count") / PIECE).alias("pieces")))
    piece = F.pmod(F.xxhash64("code"), F.coalesce("pieces", F.lit(1)))
    dealt = own.join(crowded, "bucket", "left").select("code", "id", "n", piece_key(F.col("bucket"), piece, cuts))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        return pa.table({"key": pa.array([key[0].as_py()]), **{c: pa.array([rows.column(c).to_numpy().tobytes()], pa.binary()) for c in ("code", "id", "n")}})

    packed = dealt.groupBy("key").applyInArrow(pack, "key bigint, code binary, id binary, n binary")
    return bucketed(packed, "key", int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))), crowded


def piece_key(bucket: Column, piece: Column, cuts: list[tuple[int, int]]) -> Column:
    return (bucket + piece * (len(cuts) << max(b for _, b in cuts))).alias("key")


def nearest(q: np.ndarray, bound: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in codes, distance) of the k nearest codes of each query, the earlier first, that lie within its bound."""
    out = []
    step = max(1, AT_ONCE // len(codes))
    for first in range(0, len(q), step):
        distance = np.bitwise_count(q[first : first + step, None] ^ codes)
        within = distance <= bound[first : first + step, None]
        many = within.sum(1) > k
        row, at = np.nonzero(within & ~many[:, None])
        full = np.flatnonzero(many)
        order = distance[full].astype(np.int64) * len(codes) + np.arange(len(codes))
        best = np.partition(order, k - 1, 1)[:, :k].ravel() % len(codes) if len(full) else np.zeros(0, np.int64)
        row, at = np.concatenate([row, np.repeat(full, k)]), np.concatenate([at, best])
        out.append((first + row, at, distance[row, at]))
    return tuple(np.concatenate(x) for x in zip(*out))


def hamming_topk(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """query_id, rank, neighbor_id, distance. Both tables: id and a bigint code; rows without a code are left out."""
    coded = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).where(F.col("code").isNotNull())
    entries = materialize(coded.withColumn("_n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("_n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = materialize(queries.select(F.col(id_col).alias("query_id"), F.col(code_col).alias("q")).where(F.col("q").isNotNull()))
    cuts = segments_for(entries.count())
    m, widths = len(cuts), [b for _, b in cuts]
    index, crowded = buckets(entries, cuts)

    def meet(_key: tuple, probes: pa.Table, own: pa.Table) -> pa.Table:
        names = ["q", "code", "id", "n", "distance"]
        if not probes.num_rows or not own.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        q, bound = (probes.column(c).to_numpy() for c in ("q", "bound"))
        code, first, n = (np.frombuffer(own.column(c)[0].as_py(), t) for c, t in (("code", np.int64), ("id", np.int64), ("n", np.int32)))
        row, at, distance = nearest(q.view(np.uint64), bound, code.view(np.uint64), k)
        return pa.table(dict(zip(names, (q[row], code[at], first[at], n[at].astype(np.int64), distance.astype(np.int64)))))

    # bound: no row of the k nearest is farther; a query of which fewer than k rows are found has none below BITS
    open_ = materialize(asked.select("q").distinct().withColumn("bound", F.lit(BITS)))
    order = W.partitionBy("q").orderBy("distance", "id")
    found: DataFrame | None = None
    done: list[DataFrame] = []
    for r in range(min(widths) + 1):
        # the segments that bring what is covered up to the bound, from a place that differs from query to query
        turn = F.pmod(F.col("j") + F.xxhash64("q"), F.lit(m))
        into = open_.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).where(turn < F.col("bound") - (m * r - 1))
        width = F.element_at(F.array(*map(F.lit, widths)), F.col("j") + 1)
        flipped = into.withColumn("flip", F.explode(masks(max(widths), r))).where(F.call_function("shiftrightunsigned", "flip", width) == 0)
        probes = flipped.select("q", "bound", bucket_of(F.col("q"), cuts, F.col("flip")).alias("bucket")).join(crowded, "bucket", "left")
        probes = probes.select("q", "bound", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"), "bucket").select("q", "bound", piece_key(F.col("bucket"), F.col("piece"), cuts))
        met = probes.groupBy("key").cogroup(index.groupBy("key")).applyInArrow(meet, "q bigint, code bigint, id bigint, n bigint, distance bigint")
        if found is not None:
            met = met.unionByName(found.drop("rows").join(open_, "q", "left_semi"))
        # each entry before another has a row before it, so k entries hold the k nearest rows
        ranked = met.distinct().withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")
        found = materialize(ranked.withColumn("rows", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))))
        bounds = found.where(F.col("rows") >= k).groupBy("q").agg(F.min("distance").cast("int").alias("near"))
        bounds = open_.select("q").join(bounds, "q", "left").select("q", F.coalesce("near", F.lit(BITS)).alias("bound"))
        # at the last round every value of a segment has been looked up
        still = F.lit(r < min(widths)) & (F.col("bound") > m * (r + 1) - 1)
        open_ = materialize(bounds.where(still))
        done.append(found.join(open_, "q", "left_anti"))
        if open_.isEmpty():
            break
    release(index)
    near = done[0]
    for more in done[1:]:
        near = near.unionByName(more)
    listed = near.join(entries, "code").select("q", F.col("distance").cast("int").alias("distance"), F.explode("ids").alias("neighbor_id"))
    ranked = listed.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    return asked.join(ranked, "q").select("query_id", "rank", "neighbor_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = materialize(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")))
    return hamming_topk(coded, coded.where("id % 50 = 0"))


ORACLE = """
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) > 0),
b AS (SELECT vec_id, i, embedding[i] > 0 AS bit FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM e)),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(sum(CASE WHEN q.bit <> r.bit THEN 1 ELSE 0 END) AS INTEGER) AS distance
      FROM b q JOIN b r ON q.i = r.i WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 10
"""
