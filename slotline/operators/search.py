"""Search: a weighted index and trigram similarity, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.sources.io import written


def search_index(txs: DataFrame, blocks: DataFrame, tokens: DataFrame, labels: DataFrame, addresses: DataFrame) -> DataFrame:
    """kind, key, text, weight; a labelled address replaces the plain one. Inputs: key and text."""
    arms = [f.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "text", F.lit(weight).alias("weight")) for f, kind, weight in ((txs, "tx", 100), (blocks, "block", 90), (tokens, "token", 80), (labels, "address", 60), (addresses, "address", 50))]
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    best = W.partitionBy("kind", "key").orderBy(F.desc("weight"), "text")
    return out.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each alphanumeric word, two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def search(index: DataFrame, query: str, k: int = 20, least: float = 0.05, longest: int = 80) -> DataFrame:
    scored = index.withColumn("similarity", trigram_similarity(F.col("text"), F.lit(query[:longest])))
    return scored.where(F.col("similarity") > least).withColumn("partial", F.col("similarity") < 1).orderBy(F.desc("similarity"), F.desc("weight"), "key").limit(k)


def with_token_kind(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Hits with the kind of the token they name, null for other hits. tokens: address, token_kind."""
    kinds = tokens.select(F.lower("address").alias("key"), "token_kind")
    return found.join(kinds.withColumn("kind", F.lit("token")), ["kind", "key"], "left")


def ranked_sets(own: DataFrame, counts: DataFrame, name: str, size: str, key: str = "set", order: str = "df", *more: Column) -> DataFrame:
    """Each ``key`` of ``own`` with the trigrams of its ``set`` that ``counts`` has, as an array of their ``order`` from the least,
    and with the size of the whole set."""
    grams = own.select(key, F.size("set").alias(size), F.explode("set").alias("g")).join(counts, "g", "left")
    return grams.groupBy(key, size).agg(F.array_sort(F.collect_set(order)).alias(name), *more)


def numbered(counts: DataFrame) -> DataFrame:
    """Trigrams with numbers in the order of how many sets hold them, rarest first (``gram``), and a bit for each of the 64 most frequent."""
    grams = written(counts.orderBy("df", "g").withColumn("gram", F.monotonically_increasing_id()))
    most = grams.orderBy(F.desc("gram")).limit(64).withColumn("_n", F.row_number().over(W.orderBy("gram")))
    bits = most.select("g", F.expr("shiftleft(1L, _n - 1)").alias("bit"))
    return grams.join(F.broadcast(bits), "g", "left").withColumn("bit", F.coalesce("bit", F.lit(0)))  # 64 rows


def search_many(index: DataFrame, queries: DataFrame, k: int = 20, least: float = 0.05) -> DataFrame:
    """The same for a table of queries. Inputs: kind, key, text, weight; query. Exact, without all pairs that share a trigram:

    Texts of the same trigrams are one set, of which only the k best rows can be found. For each asked set its neighbours in the
    order of texts, and some sets that share one of its rarest trigrams, give a floor, the similarity of the k-th row among them.
    A set that reaches a floor t shares at least t * m of the m trigrams asked, so also one of the m - t * m + 1 rarest, and only
    those are looked up. What two sets can share at most is told by which of the 64 most frequent trigrams they hold, before their
    trigrams are compared.

    Sets are numbers in what is joined. Its files are far smaller than its rows, so no side is left to Spark to broadcast."""
    named = lambda df, text: df.withColumn("set", F.array_sort(trigrams(F.col(text)))).where(F.size("set") > 0).withColumn("name", F.array_join("set", ""))  # noqa: E731  all are of three signs
    best = W.partitionBy("name").orderBy(F.desc("weight"), "kind", "key")
    ranked = named(index, "text").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    sets = written(ranked.groupBy("name").agg(F.first("set").alias("set"), F.min("text").alias("text"), F.collect_list(F.struct("weight", "kind", "key")).alias("best")).withColumn("id", F.monotonically_increasing_id()))
    asking = written(named(queries.select("query").distinct(), "query"))
    asked = written(asking.groupBy("name").agg(F.first("set").alias("set"), F.min("query").alias("text")).withColumn("asked", F.monotonically_increasing_id()))
    grams = numbered(sets.select(F.explode("set").alias("g")).groupBy("g").agg(F.count("*").alias("df"))).withColumn("at", F.struct("gram", "df"))
    held = F.bit_or("bit").alias("bits")
    places = written(ranked_sets(sets, grams, "d", "n", "id", "gram", held).join(sets.select("id", F.size("best").alias("rows")).hint("merge"), "id"))
    wanted = written(ranked_sets(asked, grams, "ats", "m", "asked", "at", held.alias("asked_bits")).withColumn("a", F.col("ats.gram")))
    posted = places.select("id", "d", "n", "rows", "bits", F.posexplode("d").alias("j", "gram"))
    unknown = F.col("m") - F.size("a")
    looked = wanted.select("asked", "a", "m", "asked_bits", unknown.alias("_u"), F.posexplode("ats").alias("i", "_at")).select("asked", "a", "m", "asked_bits", (F.col("_u") + F.col("i")).alias("i"), "_at.gram", "_at.df")
    met = F.sum("df").over(W.partitionBy("asked").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    few = looked.withColumn("_met", F.coalesce(met, F.lit(0))).where(F.col("_met") + F.col("df") < 20 * k).drop("_met")
    t, m, n = F.col("floor"), F.col("m"), F.col("n")
    # what must be shared, a little less for the rounding of doubles
    share = F.ceil(t * (m + n) / (1 + t) - 1e-9)
    rest = lambda size, bits: F.col(size) - F.bit_count(bits)
    most = F.bit_count(F.col("bits").bitwiseAND(F.col("asked_bits"))) + F.least(rest("n", "bits"), rest("m", "asked_bits"))

    def alike(both: DataFrame) -> DataFrame:
        out = both.withColumn("similarity", F.size("_same") / (n + m - F.size("_same")))
        return out.where((F.col("similarity") > least) & (F.col("similarity") >= t)).select("asked", "id", "rows", "similarity")

    def paired(some: DataFrame) -> DataFrame:
        """Pairs that share one of these trigrams, each once, where it shares its first one."""
        both = posted.join(some.hint("merge"), "gram").where((F.least(m - F.col("i"), n - F.col("j")) >= share) & (most >= share))
        return alike(both.withColumn("_same", F.explode(F.array(F.array_intersect("a", "d")))).where(F.col("_same")[0] == F.col("gram")))

    own, other = sets.select("text", "id", F.lit(None).cast("bigint").alias("asked")), asked.select("text", F.lit(None).cast("bigint").alias("id"), "asked")
    line = written(own.unionByName(other).orderBy("text").withColumn("place", F.monotonically_increasing_id()))
    beside = line.where("asked IS NOT NULL").select("asked", F.explode(F.sequence(F.col("place") - 2 * k, F.col("place") + 2 * k)).alias("place"))
    beside = beside.join(line.where("id IS NOT NULL").select("place", "id").hint("merge"), "place").join(places.hint("merge"), "id").join(wanted.select("asked", "a", "m").hint("merge"), "asked")
    low = F.lit(least).alias("floor")
    close = alike(beside.select("*", low).withColumn("_same", F.array_intersect("a", "d"))).withColumn("_by", F.lit(0))
    upto = F.sum("rows").over(W.partitionBy("_by", "asked").orderBy(F.desc("similarity")))
    first = close.unionByName(paired(few.select("*", low)).withColumn("_by", F.lit(1))).withColumn("_upto", upto).where(F.col("_upto") >= k)
    floors = first.groupBy("asked").agg(F.max("similarity").alias("floor"))
    prefix = looked.join(floors.hint("merge"), "asked", "left").withColumn("floor", F.coalesce("floor", F.lit(least)))
    near = paired(prefix.where(F.col("i") <= m - F.ceil(t * m - 1e-9)))
    found = near.select("asked", "id", "similarity").join(sets.select("id", "best").hint("merge"), "id").select("asked", "similarity", F.inline("best"))
    order = W.partitionBy("asked").orderBy(F.desc("similarity"), F.desc("weight"), "kind", "key")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named_by = asking.select("query", "name").join(asked.select("name", "asked").hint("merge"), "name")
    return named_by.join(top.hint("merge"), "asked").select("query", "rank", "kind", "key", "similarity")


def address_search(addresses: DataFrame, query: str) -> DataFrame:
    return addresses.where(F.startswith(F.lower("address"), F.lower(F.lit(query))) | F.contains(F.lower("label"), F.lower(F.lit(query))))
