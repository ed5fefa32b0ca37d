"""Phrases whose words occur together more often than apart, level by level over tries of frequent ones (operator 11).

Words are counted per language first; texts are rewritten once as numbers of frequent words, anything else between two
of them being a break. Pairs of neighbouring numbers are their own states and are summed as they are. From three words
on, level by level: a phrase can only be frequent if its first and last parts are (so none is missed), and it occurs just
where these two occur one word apart. Frequent phrases are put into double-array tries of bounded size, dealt by a hash of
their words and broadcast; each block of numbers advances all its positions through a trie at once, one word a level, notes
the accepting states and counts which of them stand next to each other; the blocks' counts are summed and make the next
level. There are at most (words / least) frequent phrases of a length, and a task holds one trie at a time whatever their
number.

A phrase of words w1..wj counts a; cut after k words, its parts count l and r, and its score is the least over k of
floor(1000 * a * n / (l * r)), exact in 38 digits. Phrases inside a longer one that occurs as often are dropped: one more
word decides, as counts never rise with length.

Defined results: null text is empty; null language is ``und``; breaks are never crossed, nor are texts; repeated rows count
each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import END, FOLD, LEVEL, U, as_text, block_ids, bucketed, dealt_dictionary, loosened, materialize, mix, read, release, repeated_ranges, squeezed, string_array, text_chunks, trimmed, utf8

LEAST, LONGEST, TOP = 100, 5, 2_000
#: Bytes of text of a block.
BLOCK_BYTES = 1 << 23
#: Phrases of one trie at most. A phrase has two or three digits a word, a digit makes one state at most, and with the room that
#: CLASSES leaves a state takes 130 bytes at most (about 40 in measured tries): some tens of MB a trie.
TRIE_PHRASES = 250_000
RADIX = 256
#: Nodes by number of children (most, least), and the share of places that may be taken once a class is placed.
CLASSES = ((48, 17, 1 / 16), (16, 9, 1 / 6), (8, 5, 1 / 4), (4, 2, 1 / 2))
#: Multipliers, by position, of the hash that deals phrases to tries.
DEAL = np.array([1_000_003, 786_433, 393_241, 196_613, 98_317], np.int64)
IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[[0x20, 0x09]] = True


def word_blocks(docs: DataFrame, parts: int, text_col: str, lang_col: str) -> DataFrame:
    """Two kinds of rows: block, codes (words of the block, -1 a break) and block, part, lang, words (compressed, in order of
    their codes), size (its length), counts of its dictionary. A code is a place in a part times the number of parts, plus the part."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = block_ids()
        for batch in batches_:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                for _, _, data, offsets in text_chunks(*utf8(batch.column(1).filter(pc.equal(langs, lang))), BLOCK_BYTES):
                    yield from one_block(next(ids), lang, FOLD[data], offsets)

    def one_block(block: int, lang: str, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        gap, heads = IS_GAP[data], offsets[:-1][offsets[1:] > offsets[:-1]]
        first = ~gap
        first[1:] &= gap[:-1]
        first[heads] = ~gap[heads]
        start = np.flatnonzero(first)
        if not len(start):
            return
        # a word holds no gap, so words without their gaps stand end to end
        letters = np.add.reduceat(~gap, start, dtype=np.int32)
        coded = string_array(data[~gap], np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])).dictionary_encode()
        # a break is wherever a breaking sign or another text lies between two words
        apart = np.add.reduceat(IS_BREAK[data], start, dtype=np.int32)[:-1] > 0
        apart |= np.diff(np.searchsorted(offsets, start, "right")) > 0
        words = coded.indices.to_numpy()
        code, n, bags = dealt_dictionary(coded.dictionary, np.bincount(words, minlength=len(coded.dictionary)), parts, lang.encode())
        codes = np.full(len(words) + int(apart.sum()), -1, np.int32)
        codes[np.arange(len(words)) + np.concatenate([[0], np.cumsum(apart)])] = code[words]
        yield rows(block, [pa.Codec("zstd", LEVEL).compress(codes.tobytes(), asbytes=True)], [4 * len(codes)], None, None, None, None)
        yield rows(block, None, [len(x) for _, x in bags], [p for p, _ in bags], [lang] * len(bags), [pa.Codec("zstd", LEVEL).compress(x, asbytes=True) for _, x in bags], [squeezed(x) for x in n])

    def rows(block: int, *columns: object) -> pa.RecordBatch:
        size = len(columns[1])
        types = pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *(pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in zip(columns, types))], ["block", "codes", "size", "part", "lang", "words", "counts"])

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), as_text(docs, text_col).alias("text"))
    return own.mapInArrow(trimmed(run), "block bigint, codes binary, size bigint, part int, lang string, words binary, counts binary")


def frequent_words(blocks: DataFrame, parts: int, least: int) -> DataFrame:
    """Three kinds of rows: id, lang, phrase, a of a frequent word; lang, n (words of a part in all); block, part, ids (0 for a word
    that is not frequent) of a dictionary's part. All blocks' rows of a word meet in its part, whose sums are made there;
    ids are places in a part times the number of parts, plus the part, plus 1."""

    def count(key: tuple, own: pa.Table) -> pa.Table:
        part, (langs, sizes, raw, counts, block) = key[0].as_py(), (own.column(c).to_pylist() for c in ("lang", "size", "words", "counts", "block"))
        held = [pa.decompress(x, n, "zstd", asbytes=True).split(END)[:-1] for x, n in zip(raw, sizes)]
        n = np.concatenate([loosened(x) for x in counts])
        keys = pa.array([(x, w) for x, words in zip(langs, held) for w in words], pa.struct([("lang", pa.string()), ("word", pa.binary())]))
        table = pa.table({"lang": keys.field("lang"), "word": keys.field("word"), "n": pa.array(n)})
        sums = table.group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
        often = sums.filter(pc.greater_equal(sums.column("n_sum"), least))
        ids = parts * np.arange(len(often)) + part + 1
        known = {k: i for k, i in zip(zip(often.column("lang").to_pylist(), often.column("word").to_pylist()), ids.tolist())}
        back = [squeezed(np.fromiter((known.get((x, w), 0) for w in words), np.int64, len(words))) for x, words in zip(langs, held)]
        totals = table.group_by("lang", use_threads=False).aggregate([("n", "sum")])
        blank = lambda k, t: pa.nulls(k, t)
        k, m, b = len(often), len(totals), len(back)
        columns = {
            "id": [pa.array(ids, pa.int64()), blank(m + b, pa.int64())], "lang": [often.column("lang").combine_chunks(), totals.column("lang").combine_chunks(), blank(b, pa.string())],
            "phrase": [often.column("word").combine_chunks().cast(pa.string()), blank(m + b, pa.string())], "a": [often.column("n_sum").combine_chunks(), blank(m + b, pa.int64())],
            "n": [blank(k, pa.int64()), totals.column("n_sum").combine_chunks(), blank(b, pa.int64())], "block": [blank(k + m, pa.int64()), pa.array(block, pa.int64())],
            "part": [blank(k + m, pa.int32()), pa.array([part] * b, pa.int32())], "ids": [blank(k + m, pa.binary()), pa.array(back, pa.binary())],
        }
        return pa.table({name: pa.concat_arrays(x) for name, x in columns.items()})

    dictionaries = blocks.where("part is not null").select("part", "block", "lang", "size", "words", "counts")
    return dictionaries.groupBy("part").applyInArrow(count, "id bigint, lang string, phrase string, a bigint, n bigint, block bigint, part int, ids binary")


def numbered(df: DataFrame) -> DataFrame:
    """``df``, written, plus id: numbers of their own, in any order."""
    return materialize(df.withColumn("id", F.monotonically_increasing_id()))


def numbers(blocks: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """ids (int32 of frequent words in text order, 0 a break) of each block."""

    def rewrite(_key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        lists = [(p, loosened(x)) for p, x in zip(known.column("part").to_pylist(), known.column("ids").to_pylist())]
        ids = np.zeros(max((p + parts * (len(x) - 1) for p, x in lists), default=-1) + 2, np.int32)
        for p, x in lists:
            ids[p + parts * np.arange(len(x))] = x
        ids[-1] = 0  # code -1, a break
        out = []
        for raw, n in zip(own.column("codes").to_pylist(), own.column("size").to_pylist()):
            got = ids[np.frombuffer(pa.decompress(raw, n, "zstd"), np.int32)]
            keep = got > 0
            keep[:-1] |= got[1:] > 0
            out.append(got[keep].tobytes())
        return pa.table({"ids": pa.array(out, pa.binary())})

    own, known = blocks.where("part is null").select("block", "codes", "size"), found.where("block is not null").select(F.col("block").alias("of"), "part", "ids")
    return own.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(rewrite, "ids binary")


def digits_of(own: np.ndarray, digits: int) -> np.ndarray:
    """Symbols as numbers to the base RADIX, highest digit first; rows of words become rows of digits."""
    return np.stack([own >> (8 * k) & 255 for k in range(digits - 1, -1, -1)], -1).reshape(*own.shape[:-1], -1)


def double_array(phrases: np.ndarray) -> dict[str, np.ndarray]:
    """A trie of the rows of ``phrases`` (distinct, sorted): from state s by digit c to base[s] + c where check there is s. A word is
    its place among the trie's words, in digits to the base 256. At a last state base is the phrase's number.

    Nodes of many children take fresh stretches; the others are placed all at once, class by class of falling size, at random
    bases: those that fit stay, the rest try again. Nodes of one child fill what is free."""
    symbols = np.unique(phrases)
    digits = max(1, -(-int(len(symbols) - 1).bit_length() // 8))
    own = digits_of(np.searchsorted(symbols, phrases), digits)
    n, depth = own.shape
    new = np.zeros(n, bool)
    new[0] = True
    parent, symbol, above, count = [], [], np.zeros(n, np.int64), 1
    for d in range(depth):
        new[1:] |= own[1:, d] != own[:-1, d]
        at = np.flatnonzero(new)
        parent.append(above[at])
        symbol.append(own[at, d])
        above = count + np.cumsum(new) - 1
        count += len(at)
    parent, symbol = np.concatenate(parent), np.concatenate(symbol)
    # children of a node stand together; node k + 1 is the k-th entry
    head = np.flatnonzero(np.diff(parent, prepend=-1))
    fan = np.diff(np.append(head, len(parent)))
    rng = np.random.default_rng(0)
    slot = np.zeros(count, np.int64)
    many = np.flatnonzero(fan > CLASSES[0][0])
    children = repeated_ranges(head[many], fan[many])
    slot[children + 1] = np.repeat(RADIX * (1 + np.arange(len(many))), fan[many]) + symbol[children]
    used = np.zeros(RADIX * (1 + len(many)), bool)
    used[0] = True
    used[slot[children + 1]] = True
    for most, least, load in CLASSES:
        left = np.flatnonzero((fan <= most) & (fan >= least))
        room = max(len(used), RADIX + int((used.sum() + fan[left].sum()) / load))
        used = np.concatenate([used, np.zeros(room - len(used), bool)])
        claim = np.zeros(room, np.int64)
        while len(left):
            children, first = repeated_ranges(head[left], fan[left]), np.cumsum(fan[left]) - fan[left]
            to, node = np.repeat(rng.integers(0, room - RADIX + 1, len(left)), fan[left]) + symbol[children], np.repeat(left, fan[left])
            claim[to] = node
            fits = np.logical_and.reduceat((claim[to] == node) & ~used[to], first)
            kept = np.repeat(fits, fan[left])
            slot[children[kept] + 1] = to[kept]
            used[to[kept]] = True
            left = left[~fits]
    single = head[fan == 1]
    free = np.flatnonzero(~used)
    free = np.concatenate([free, len(used) + np.arange(max(0, len(single) - len(free)))])
    slot[single + 1] = free[: len(single)]
    size = int(slot.max()) + 1
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    base[slot[parent[head]]] = slot[head + 1] - symbol[head]
    check[slot[1:]] = slot[parent]
    base[slot[above]] = np.arange(n)
    return {"symbols": symbols, "base": base, "check": check}


def walk(trie: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions ``at`` those where a phrase of ``depth`` words begins, and its number: all advance together, digit by digit."""
    symbols, base, check = trie["symbols"], trie["base"], trie["check"]
    own = np.minimum(np.searchsorted(symbols, ids), len(symbols) - 1)
    known = symbols[own] == ids
    digits = max(1, -(-int(len(symbols) - 1).bit_length() // 8))
    state = np.zeros(len(at), np.int64)
    for d in range(depth):
        ok = known[at + d]
        at, state = at[ok], state[ok]
        for k in range(digits - 1, -1, -1):
            to = base[state] + (own[at + d] >> (8 * k) & 255)
            ok = (to >= 0) & (to < len(check))
            ok &= check[np.where(ok, to, 0)] == state
            at, state = at[ok], to[ok]
    return at, base[state]


def dealt(words: np.ndarray, shards: int) -> np.ndarray:
    return (words.astype(np.int64) @ DEAL[: words.shape[1]]) % shards


def tries(phrases: DataFrame, depth: int) -> list[Broadcast]:
    """Broadcast tries of id, words; each built in a task, brought over one at a time, of TRIE_PHRASES phrases at most."""
    spark = phrases.sparkSession
    shards = max(1, -(-phrases.count() // TRIE_PHRASES))
    while True:
        shard = F.pmod(reduce(lambda a, b: a + b, (F.col("words")[d].cast("bigint") * int(DEAL[d]) for d in range(depth))), F.lit(shards)).cast("int")
        placed = phrases.select("id", "words", shard.alias("shard"))
        if shards == 1 or placed.groupBy("shard").count().where(F.col("count") > TRIE_PHRASES).isEmpty():
            break
        shards += max(1, shards // 4)

    def build(key: tuple, own: pa.Table) -> pa.Table:
        words = own.column("words").combine_chunks().flatten().to_numpy().reshape(-1, depth)
        order = np.lexsort(words.T[::-1])
        trie = double_array(words[order]) | {"ids": own.column("id").to_numpy()[order]}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in trie.items()}})

    built = materialize(placed.groupBy("shard").applyInArrow(build, "shard int, symbols binary, base binary, check binary, ids binary"))
    out = []
    for r in built.toLocalIterator():
        kinds = {"symbols": np.int32, "base": np.int32, "check": np.int32, "ids": np.int64}
        out.append(spark.sparkContext.broadcast((shards, r.shard, {k: np.frombuffer(r[k], t) for k, t in kinds.items()})))
    release(built)
    return out


def packed(parts: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row for each part that the keys (a, b) are dealt to: sorted keys, the first as steps, and what they count."""
    part = (mix(a.astype(U) * U(0x9E3779B97F4A7C15) ^ b.astype(U)) % U(parts)).astype(np.int64)
    order = np.lexsort((b, a, part))
    cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
    own = [order[x:y] for x, y in zip(cuts, cuts[1:])]
    columns = [pa.array([part[k[0]] for k in own], pa.int32()), *(pa.array([planes(f(k)) for k in own], pa.binary()) for f in (lambda k: np.diff(a[k], prepend=0), lambda k: b[k], lambda k: n[k]))]
    return pa.RecordBatch.from_arrays(columns, PACKED)


PACKED = ["part", "a", "b", "n"]
PACKED_TYPE = "part int, a binary, b binary, n binary"


def planes(values: np.ndarray) -> bytes:
    """Longs as compressed planes of their bytes."""
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def unplaned(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd"), np.uint8).reshape(8, n).T).view("<i8").ravel()


def summed(rows: DataFrame, least: int) -> DataFrame:
    """first, last, a of keys that count ``least`` over all blocks: all rows of a key meet in its part, and are added up there."""

    def add(_key: tuple, own: pa.Table) -> pa.Table:
        a, b, n = (np.concatenate([f(unplaned(x)) for x in own.column(c).to_pylist()]) for c, f in (("a", np.cumsum), ("b", np.asarray), ("n", np.asarray)))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-2) != 0))
        total = np.add.reduceat(n, first)
        keep = first[total >= least]
        return pa.table({"first": a[keep], "last": b[keep], "a": total[total >= least]})

    return rows.groupBy("part").applyInArrow(add, "first bigint, last bigint, a bigint")


def overlaps(texts: DataFrame, sent: list[Broadcast], depth: int, parts: int) -> DataFrame:
    """Packed rows of a block's counts of accepted phrases that overlap in all but one word: the phrases of one word more."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, np.int32)
                if len(ids) <= depth:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(ids, depth)
                whole = np.flatnonzero((windows > 0).all(1))
                accepted = np.full(len(ids) + 1, -1, np.int64)
                deal: np.ndarray | None = None
                for b in sent:
                    shards, shard, trie = b.value
                    deal = dealt(windows[whole], shards) if deal is None else deal
                    at, number = walk(trie, ids, whole[deal == shard], depth)
                    accepted[at] = trie["ids"][number]
                    if len(sent) > 1:  # one trie at a time in a worker's memory; the value is loaded again from the local copy
                        b.__dict__.pop("_value", None)
                here, there = accepted[:-1], accepted[1:]
                both = (here >= 0) & (there >= 0)
                keys, inverse = np.unique(np.concatenate([here[both], there[both]]), return_inverse=True)
                k = int(both.sum())
                pair, n = np.unique(inverse[:k] * np.int64(len(keys)) + inverse[k:], return_counts=True)
                if len(pair):
                    yield packed(parts, keys[pair // len(keys)], keys[pair % len(keys)], n)

    return texts.mapInArrow(trimmed(run), PACKED_TYPE)


def pair_counts(texts: DataFrame, parts: int) -> DataFrame:
    """Packed rows of a block's counts of neighbouring frequent words."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, np.int32).astype(np.int64)
                both = (ids[:-1] > 0) & (ids[1:] > 0)
                pair, n = np.unique(ids[:-1][both] << 32 | ids[1:][both], return_counts=True)
                if len(pair):
                    yield packed(parts, pair >> 32, pair & 0xFFFFFFFF, n)

    return texts.mapInArrow(trimmed(run), PACKED_TYPE)


def grown(sums: DataFrame, below: DataFrame) -> DataFrame:
    """Rows of the next level from (first, last, a): the parts' words, counts and texts put together."""
    p = below.select(F.col("id").alias("first"), "lang", "words", F.col("a").alias("pa"), "pre", F.col("phrase").alias("head"))
    s = below.select(F.col("id").alias("last"), F.element_at("words", -1).alias("w"), F.col("a").alias("sa"), "suf", "word")
    joined = sums.join(p, "first").join(s, "last")
    return joined.select("lang", "first", "last", F.concat("words", F.array("w")).alias("words"), "a", F.concat("pre", F.array("pa")).alias("pre"), F.concat("suf", F.array("sa")).alias("suf"), F.concat_ws(" ", "head", "word").alias("phrase"), "word")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """Of each length from one: id, lang, first and last (ids of all words but the last, but the first), words, a, pre and suf
    (counts of its first and of its last 1, 2, .. words), phrase, word (the last); and lang, n (words in all)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(word_blocks(docs, parts, text_col, lang_col), "block", parts)
    found = materialize(frequent_words(blocks, parts, least))
    totals = found.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    none = F.array().cast("array<bigint>")
    level = found.where("id is not null").select("id", "lang", F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), F.array(F.col("id").cast("int")).alias("words"), "a", none.alias("pre"), none.alias("suf"), "phrase", F.col("phrase").alias("word"))
    texts = materialize(numbers(blocks, found, parts))
    release(blocks)
    levels = [level, numbered(grown(summed(pair_counts(texts, parts), least), level))]
    for depth in range(2, longest):
        sent = tries(levels[-1], depth)
        if not sent:
            break
        levels.append(numbered(grown(summed(overlaps(texts, sent, depth, parts), least), levels[-1])))
        for b in sent:
            b.unpersist()
    release(texts)
    return levels, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two words and more that no longer one replaces."""
    levels, totals = frequent_phrases(docs, least, longest, text_col, lang_col)
    parts = []
    for k, level in enumerate(levels[1:], 2):
        if k < len(levels):
            level = level.join(levels[k].select(F.explode(F.array("first", "last")).alias("id"), "a"), ["id", "a"], "left_anti")
        parts.append(level.select("lang", "phrase", "a", "pre", "suf"))
    whole = reduce(DataFrame.unionByName, parts).join(totals, "lang")
    # counts have at most 17 digits, so that 1000 * a * n and l * r keep all of theirs
    wide = lambda x: F.col(x).cast("decimal(17,0)")
    cut = whole.select("lang", "phrase", "a", "n", F.posexplode(F.arrays_zip(F.col("pre").alias("l"), F.reverse("suf").alias("r"))).alias("k", "c")).select("lang", "phrase", "a", "n", "k", "c.l", "c.r")
    top, under = F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r")
    scored = cut.withColumns({"_top": top, "_under": under}).select("lang", "phrase", "a", "n", F.struct(F.expr("_top div _under").alias("score"), "k", "l", "r").alias("c"))
    return scored.groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` rows of ``collocations``, numbered from 1."""
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(collocations(read(spark, sf_dir, "documents")))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, list_slice(w, i, i + j - 1) AS g FROM (SELECT lang, w, j, unnest(range(1, len(w) - j + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS j FROM w) WHERE len(w) >= j)),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
x AS (SELECT DISTINCT s.lang, s.phrase FROM f b, (VALUES (0), (1)) v(o), f s
      WHERE len(b.g) > 2 AND s.lang = b.lang AND s.phrase = array_to_string(list_slice(b.g, 1 + v.o, len(b.g) - 1 + v.o), ' ') AND s.a = b.a),
c AS (SELECT f.lang, f.phrase, f.a, f.g, unnest(range(1, len(f.g))) AS k FROM f ANTI JOIN x USING (lang, phrase) WHERE len(f.g) > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
      FROM c JOIN t USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.g, 1, c.k), ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.g, c.k + 1, len(c.g)), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b)
WHERE rank <= 2000
"""
