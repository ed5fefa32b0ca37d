"""Mixing sources to target weights (operator 7).

Each row gets a hash-random key; a source's rows in key order are its random permutation. Keys are cut into ranges, word
counts are summed per source and range, running sums over the ranges give each range's offset, and a second running sum
inside the range gives each row's place in its source. A source's budget is cut there exactly: whole passes first, then
the rows before the cut, the row at the cut in part. A hot source is spread over all ranges.

Defined results: null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in order;
rows equal in every respect share the cut in any order; with no words at all every target is 0; extra columns are kept
by ``mix`` and may carry any name but the ones it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, materialize, read

WEIGHTS = (5, 2, 1)
#: The mix's words in half sizes of the corpus (3: 150 %) and the most passes over a source.
HALVES, MOST = 3, 2
ROWS_PER_RANGE = 4_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target. Takes one row a source in one task, so sources should be some thousands at most. The level
    of water-filling: with the k sources of least 2 * size / weight held at
    2 * size, the rest share what is left by weight; the first k at which none of the rest rises above 2 * size holds."""
    n = len(weights)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % n + 1).cast("int")).cast("bigint")
    ranked = totals.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * MOST)
    every = W.partitionBy()
    upto = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = ranked.select(
        "source", "source_size", "cap", "w",
        (F.sum("source_size").over(every) * HALVES - 2 * F.coalesce(F.sum("cap").over(upto), F.lit(0))).alias("twice_left"),
        (2 * (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))).alias("twice_w"),
    )
    fits = left.withColumn("level", F.col("twice_left") / F.col("twice_w")).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("cap") / F.col("w"))).over(every)
    return fits.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` (with a long ``size``) plus source_size, target, taken; ``docs`` should be cheap to read twice."""
    keyed = docs.withColumn("_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("size").cast("string"))), 1, 15), 16, 10).cast("bigint"))
    targets = source_targets(keyed.select(F.col(source_col).alias("source"), "size"), weights)
    ranges = max(1, -(-docs.count() // ROWS_PER_RANGE))
    keyed = keyed.withColumn("_range", F.floor(F.col("_key") / F.lit((1 << 60) / ranges)).cast("int"))
    sums = keyed.groupBy(F.col(source_col).alias("source"), "_range").agg(F.sum("size").alias("_sum"))
    starts = sums.withColumn("_start", F.sum("_sum").over(W.partitionBy("source").orderBy("_range")) - F.col("_sum"))
    ranged = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("_source"), starts["_range"].alias("_at"), "_start", "source_size", "target")
    own = W.partitionBy(source_col, "_range").orderBy("_key", id_col, "size").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = placed.join(ranged, placed[source_col].eqNullSafe(ranged["_source"]) & (placed["_range"] == ranged["_at"]))
    passes = F.coalesce(F.floor(F.try_divide(F.floor("target"), F.col("source_size"))), F.lit(0))
    rest = F.floor("target") - passes * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start") - F.col("_inside")))
    return joined.select(*docs.columns, "source_size", "target", (passes * F.col("size") + partial).cast("bigint").alias("taken"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(as_text(docs, text_col)).alias("size"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself in ``docs``' columns: a row for each pass over a document, the cut one holding its first words.
    Texts without words stay once; ``n_chars``, where there is one, is counted again."""
    # the row is packed, so its columns may have any name
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", word_count(as_text(docs, "text")).alias("size"))
    taken = mix(own, weights).withColumn("_whole", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)))
    whole = F.col("row")["text"]
    rest = F.col("taken") - F.col("_whole") * F.col("size")
    words = F.when(rest > 0, first_words(whole, rest)).otherwise(F.lit(""))
    copies = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_whole") + F.when((rest > 0) & (F.col("size") > 0), 1).otherwise(0)).cast("int")))).where("_whole > 0 or taken > 0")
    text = F.when(F.col("_copy") <= F.col("_whole"), whole).otherwise(words)
    new = {"text": text, **({"n_chars": F.length(text).cast("bigint")} if "n_chars" in docs.columns else {})}
    return copies.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def first_words(text: Column, n: Column) -> Column:
    """The text's first ``n`` words with the white space before and between them."""
    parts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(materialize(sizes(read(spark, sf_dir, "documents")))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM d),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM t),
l AS (SELECT a.source, a.source_size, a.w, a.cap,
        CAST(3 * (SELECT sum(source_size) FROM w) - 2 * coalesce(sum(b.cap), 0) AS DOUBLE) / CAST(2 * ((SELECT sum(w) FROM w) - coalesce(sum(b.w), 0)) AS DOUBLE) AS level
      FROM w a LEFT JOIN w b ON b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))
      GROUP BY ALL),
v AS (SELECT min_by(level, cap / w) AS level FROM l WHERE level * w <= cap),
g AS (SELECT w.source, w.source_size, least(CAST(w.cap AS DOUBLE), coalesce(v.level * w.w, CAST(w.cap AS DOUBLE))) AS target FROM w, v),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken FROM q
"""
