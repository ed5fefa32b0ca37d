"""Cross-entropy difference with matched n-gram models (operator 6).

Two bigram models, of the target rows and of all rows (background), share one vocabulary, every word of the corpus, and
one smoothing: p(w | v) = (c(v, w) + a) / (c(v) + a V), where a is ``ADD`` for the target and ``ADD`` times the ratio of
the two texts' sizes for the background, so both are smoothed as text of the target's size would be. A document's score
is its mean of log p_target - log p_background over its words, in nats; higher is more like the target. The first word of
a text follows a start mark.

log p splits into a term of the word pair and a term of the first word, so a document's loss is a sum over its distinct
pairs and first words, each needing only that key's two counts. Text is read in blocks of rows; a block sends, for each
range of key hashes, one packed row: the keys, and which of its documents hold each how often. The task of a range adds up
the counts of its keys over all blocks, turns them into loss terms and returns each document's part. Ranges grow in number
with the corpus, hot keys cost a row a block, and no table of counts leaves its task.

Defined results: null or empty text has no words and a null score; repeated rows and null ids give a row each; without
target words, or in an empty table, scores are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BASE, U, Words, as_text, mix, read, runs, text_chunks, trimmed, utf8

ADD = 0.05
START = mix(np.array([0x5354415254], U))[0]
#: Rows of about this many bytes are one block; a range of keys holds about this many pairs.
BLOCK_BYTES, PAIRS_PER_RANGE = 1 << 22, 2_000_000
#: Text for a range of the vocabulary.
BYTES_PER_RANGE = 1 << 26


def text_rows(docs: DataFrame, target: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(target, F.lit(False)).alias("target"), as_text(docs, text_col).alias("text"))


def vocabulary(rows: DataFrame) -> tuple[int, int, int]:
    """Distinct words of all rows, words of the target, words of all. Words are counted in ranges of their hash, whose number
    grows with the corpus."""
    bytes_ = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // BYTES_PER_RANGE))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            goal = b.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for row, end, data, offsets in text_chunks(*utf8(b.column("text")), BLOCK_BYTES):
                w = Words(data, offsets)
                own = np.unique(w.hash)
                cut = np.searchsorted(((own >> U(32)) * U(ranges) >> U(32)).astype(np.int64), np.arange(ranges + 1))
                used = np.flatnonzero(cut[1:] > cut[:-1])
                if len(used):
                    packed = [own[a:z].tobytes() for a, z in zip(cut[used], cut[used + 1])]
                    n, t, none = len(w.hash), int(w.count[goal[row:end]].sum()), [0] * (len(used) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(packed, pa.binary()), pa.array([n, *none], pa.int64()), pa.array([t, *none], pa.int64())], ["part", "words", "n", "t"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = n = t = 0
        known, waiting, size, part = np.zeros(0, U), [], 0, None
        for b in batches:
            n, t = n + sum(b.column("n").to_pylist()), t + sum(b.column("t").to_pylist())
            for own, raw in zip(b.column("part").to_pylist(), b.column("words").to_pylist()):
                if own != part or size > max(len(known), 1 << 16):  # merged when as many wait as are known
                    known, waiting, size = np.unique(np.concatenate([known, *waiting])), [], 0
                if own != part:
                    v, known, part = v + len(known), np.zeros(0, U), own
                waiting.append(np.frombuffer(raw, U))
                size += len(waiting[-1])
        v += len(np.unique(np.concatenate([known, *waiting])))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([n], pa.int64()), pa.array([t], pa.int64())], ["v", "n", "t"])

    packed = rows.select("target", "text").mapInArrow(trimmed(words), "part int, words binary, n bigint, t bigint")
    got = packed.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(trimmed(count), "v bigint, n bigint, t bigint").agg(F.sum("v"), F.sum("t"), F.sum("n")).first()
    return tuple(int(x or 0) for x in got)


def block_keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, count) of pairs (last key bit 1) and first words (bit 0) of each text, sorted by key and row."""
    head = np.concatenate([[True], words.row[1:] != words.row[:-1]]) if len(words.row) else np.zeros(0, bool)
    first = np.where(head, START, np.concatenate([[U(0)], words.hash[:-1]])) if len(words.row) else words.hash
    key = np.concatenate([mix(first * BASE + words.hash) | U(1), first & ~U(1)])
    row = np.concatenate([words.row, words.row])
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    return key[new], row[new], np.diff(np.concatenate([new, [len(key)]]))


def cross_entropy_difference(docs: DataFrame, target: Column, add: float = ADD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score."""
    rows = text_rows(docs, target, id_col, text_col)
    spark = docs.sparkSession
    v, goal_words, all_words = vocabulary(rows)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * all_words // PAIRS_PER_RANGE))
    kind = docs.schema[id_col].dataType.simpleString()

    ids_type = pa.list_(to_arrow_type(docs.schema[id_col].dataType))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            goal = b.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, offsets in text_chunks(*utf8(b.column("text")), BLOCK_BYTES):
                block += 1
                words = Words(data, offsets)
                key, at, n = block_keys(words)
                at = at * 2 + goal[row:end][at]
                own, first = np.unique(key, return_index=True)
                edge = np.concatenate([first, [len(key)]])
                size = np.diff(edge)
                cut = np.searchsorted(((own >> U(32)) * U(ranges) >> U(32)).astype(np.int64), np.arange(ranges + 1))
                used = np.flatnonzero(cut[1:] > cut[:-1])
                packed = [(own[i : i + 1].tobytes() + narrow(np.diff(own[i:j])), narrow(size[i:j]), narrow(at[edge[i] : edge[j]]), narrow(n[edge[i] : edge[j]])) for i, j in zip(cut[used], cut[used + 1])]
                cols = [[*c, b""] for c in zip(*packed)] or [[b""]] * 4
                m = len(used)
                ids = pa.array([None] * m + [b.column("doc_id").slice(row, end - row).to_pylist()], ids_type)
                counts = pa.array([None] * m + [words.count.tolist()], pa.list_(pa.int64()))
                place = np.concatenate([used, [block % ranges]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.full(m + 1, block)), *(pa.array(c, pa.binary()) for c in cols), ids, counts], ["range", "block", "keys", "sizes", "at", "n", "ids", "counts"])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "range"):
            ids = group.filter(pc.is_valid(group.column("ids")))
            group = group.filter(pc.is_null(group.column("ids")))
            yield from ids.select(["block", "at", "n", "ids", "counts"]).rename_columns(["block", "at", "part", "ids", "counts"]).to_batches()
            if not group.num_rows:
                continue
            keys = [np.cumsum(np.concatenate([np.frombuffer(x[:8], U), wide(x[8:]).view(U)])) for x in group.column("keys").to_pylist()]
            sizes, at, n = ([wide(x) for x in group.column(c).to_pylist()] for c in ("sizes", "at", "n"))
            known, which = np.unique(np.concatenate(keys), return_inverse=True)
            holder = np.repeat(which, np.concatenate(sizes))
            all_at, all_n = np.concatenate(at), np.concatenate(n)
            everywhere = np.bincount(holder, all_n, len(known))
            goal_only = np.bincount(holder, all_n * (all_at & 1), len(known))
            ratio = all_words / max(goal_words, 1)
            pair = (known & U(1)).astype(bool)
            prior = np.where(pair, add, add * v)
            delta = np.where(pair, 1, -1) * (np.log(goal_only + prior) - np.log(everywhere + prior * ratio))
            weighed, start = delta[holder] * all_n, 0
            parts, places = [], []
            for own in at:
                doc, first = np.unique(own >> 1, return_inverse=True)
                parts.append(np.bincount(first, weighed[start : start + len(own)]).tobytes())
                places.append(narrow(doc))
                start += len(own)
            m = len(parts)
            yield pa.RecordBatch.from_arrays([group.column("block").combine_chunks(), pa.array(places, pa.binary()), pa.array(parts, pa.binary()), pa.nulls(m, ids_type), pa.nulls(m, pa.list_(pa.int64()))], ["block", "at", "part", "ids", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "block"):
            own = group.filter(pc.is_valid(group.column("ids")))
            ids, counts = own.column("ids").combine_chunks().flatten(), np.array(own.column("counts")[0].as_py(), np.int64)
            total = np.zeros(len(counts))
            for at, part in zip(group.column("at").to_pylist(), group.column("part").to_pylist()):
                if part:
                    total[wide(at)] += np.frombuffer(part)
            empty = (counts == 0) | (goal_words == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(total / np.maximum(counts, 1), mask=empty)], ["doc_id", "n_words", "score"])

    packed = rows.mapInArrow(trimmed(blocks), f"range int, block bigint, keys binary, sizes binary, at binary, n binary, ids array<{kind}>, counts array<bigint>")
    parts = packed.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(trimmed(losses), f"block bigint, at binary, part binary, ids array<{kind}>, counts array<bigint>")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(trimmed(gather), f"doc_id {kind}, n_words bigint, score double")


def narrow(x: np.ndarray) -> bytes:
    """64-bit integers cut to the fewest bytes that hold them, after a byte that names the number."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(np.ascontiguousarray(x).astype(x.dtype if x.dtype.itemsize == 8 else np.int64, copy=False).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def wide(raw: bytes) -> np.ndarray:
    width, out = raw[0], np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return out.view("<i8").ravel()


#: In the query the rows of this source are the domain to select for.
TARGET_SOURCE = "src1"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(read(spark, sf_dir, "documents"), F.col("source") == TARGET_SOURCE)
