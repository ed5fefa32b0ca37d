"""Exact removal of repeated strings and passages with linear suffix arrays (operator 8).

A ``Measure`` says what repeats: windows of ``length`` bytes, or of ``length`` words whatever white space parts them. Every
window names an anchor: the shorter run of bytes (words) inside it with the least hash, the last one of equals. Equal
windows name equal anchors, and the windows that name one occurrence of an anchor are a run; what they span is its
context. An anchor that occurs once can hold no repeated window. For the others, equal contexts are counted once, and
the distinct contexts of an anchor meet in one task. There a suffix array over word tokens (Lyndon grouping, see
``suffixarray``) finds the word starts whose suffix agrees with a neighbour far enough. For words these are the repeated
windows. For bytes, the windows that begin at such a start or anywhere in the token before it are then checked exactly.
Anchors with too many distinct contexts for a task are split by longer anchors inside those contexts, at last by whole
windows, so no context is skipped. Several measures share one scan of the texts and all joins.

Defined results: null or empty text has 0 bytes, none removed; texts shorter than a window keep all; exact copies of at
least a window lose everything; repeated ids and null ids are rows of their own; an empty table gives no rows; extra
columns of any name are kept by ``cleaned``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, RollingHash, Words, as_text, materialize, mix, read, release, text_chunks, trimmed, utf8
from .suffixarray import suffix_array


@dataclass(frozen=True)
class Measure:
    """Windows of ``length`` bytes or words, ``anchor`` long parts inside them, and the anchors for groups beyond ``TASK``."""

    by_word: bool
    length: int
    anchor: int
    longer: tuple[int, int]


BYTES = Measure(False, 400, 64, (240, 400))
#: Passages of fifty words: of prose they have 200 to 400 bytes, so most are too short for ``BYTES``.
PASSAGES = Measure(True, 50, 8, (30, 50))
#: Distinct contexts of an anchor that one task takes.
TASK = 8_000
SA_BYTES = 1 << 17
PLACE = U((1 << 36) - 1)
TOKEN = re.compile(rb"[^ \t\n\r\f\v]*[ \t\n\r\f\v]|[^ \t\n\r\f\v]+")


def anchored(rolling: RollingHash, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that name the same anchor: row, first window (in its text), windows, anchor's and context's hash.
    ``offsets``: where each text's symbols begin, and the end of all."""
    n_symbols = int(offsets[-1])
    grams, windows = n_symbols - anchor + 1, n_symbols - length + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U), np.zeros(0, U))
    if windows <= 0:
        return none
    at = np.arange(grams)
    code = mix(rolling.of(at, at + anchor))
    least = (code & ~PLACE) | (PLACE - at.astype(U))
    span, have = length - anchor + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: -(span - have)], least[span - have :])
    place = (PLACE - (least & PLACE)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(windows), "right") - 1
    use = np.flatnonzero(np.arange(windows) + length <= offsets[row + 1])
    if not len(use):
        return none
    new = np.concatenate([[True], (place[use][1:] != place[use][:-1]) | (row[use][1:] != row[use][:-1])])
    first = use[new]
    n = np.diff(np.concatenate([np.flatnonzero(new), [len(use)]]))
    context = mix(rolling.of(first, first + n + length - 1) + mix(n.astype(U)) + mix((place[first] - first).astype(U)))
    return row[first], first - offsets[row[first]], n, code[place[first]], context


def measured(data: np.ndarray, offsets: np.ndarray, measure: Measure, anchor: int) -> tuple[tuple[np.ndarray, ...], Words | None]:
    """``anchored`` over bytes or words, and the words. Anchors and contexts of words are told apart from those of bytes."""
    if not measure.by_word:
        return anchored(RollingHash(data), offsets, measure.length, anchor), None
    words = Words(data, offsets)
    row, first, n, code, context = anchored(RollingHash(words.hash), np.concatenate([[0], np.cumsum(words.count)]), measure.length, anchor)
    return (row, first, n, mix(code ^ U(measure.length)), context), words


def repeated_passages(contexts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its windows of ``length`` words occur more than once among all the contexts' windows."""
    words = Words(np.frombuffer(b"".join(contexts), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in contexts])]).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(words.count)])
    end = words.row + np.arange(len(words.hash))  # place among the symbols, which hold a 0 after each context
    symbols = np.zeros(len(words.hash) + len(contexts), np.int64)
    symbols[end] = np.unique(words.hash, return_inverse=True)[1] + 1
    order = suffix_array(symbols)
    word = np.full(len(symbols), -1)
    word[end] = np.arange(len(end))
    at = word[order]
    # a separator or a suffix too short for a window has no partner
    at = at[at >= 0]
    at = at[at + length <= edge[words.row[at] + 1]]
    rolling = RollingHash(words.hash)
    code = rolling.of(at, at + length)
    same = code[1:] == code[:-1]
    mark = np.zeros(len(words.hash) + 1, bool)
    mark[at[1:][same]] = True
    mark[at[:-1][same]] = True
    return [mark[edge[k] : edge[k] + windows[k]] for k in range(len(contexts))]


def repeated_windows(contexts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its windows occur more than once among all the contexts' windows."""
    tokens = [TOKEN.findall(c) for c in contexts]
    rank = {t: k + 1 for k, t in enumerate(sorted({t for own in tokens for t in own}))}
    symbols, starts, heads, owner, at = [], [], [], [], 0
    for k, own in enumerate(tokens):
        symbols.extend(map(rank.__getitem__, own))
        symbols.append(0)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        first = at + np.concatenate([[0], np.cumsum(sizes)])
        starts.append(first)
        heads.append(np.concatenate([[0], sizes]))
        owner.append(np.full(len(own) + 1, k))
        at = int(first[-1])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    start, head, own = np.concatenate(starts), np.concatenate(heads), np.concatenate(owner)
    rolling = RollingHash(data)
    order = suffix_array(np.array(symbols))
    need = np.maximum(length - head, 1)
    agree = np.zeros(len(start), bool)
    for a, b in ((order[:-1], order[1:]), (order[1:], order[:-1])):
        fits = (start[a] + need[a] <= edge[own[a] + 1]) & (start[b] + need[a] <= edge[own[b] + 1])
        a, b = a[fits], b[fits]
        same = rolling.of(start[a], start[a] + need[a]) == rolling.of(start[b], start[b] + need[a])
        agree[a[same]] = True
    # windows that start at an agreeing word start or in the token before it, its first byte included (the same bytes may
    # begin inside a word elsewhere), and windows with no word start inside
    hit = np.flatnonzero(agree)
    lone = np.flatnonzero(head >= length)
    low = np.concatenate([start[hit] - head[hit], start[lone] - head[lone]])
    high = np.concatenate([start[hit] + 1, start[lone] - length + 1])
    low = np.maximum(low, edge[np.concatenate([own[hit], own[lone]])])
    high = np.minimum(high, edge[np.concatenate([own[hit], own[lone]])] + np.array(windows)[np.concatenate([own[hit], own[lone]])])
    size = np.maximum(high - low, 0)
    place = np.unique(np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())) if len(size) else np.zeros(0, np.int64)
    code = rolling.of(place, place + length)
    _, which, count = np.unique(code, return_inverse=True, return_counts=True)
    mark = np.zeros(len(data) + 1, bool)
    mark[place[count[which] > 1]] = True
    return [mark[edge[k] : edge[k] + windows[k]] for k in range(len(contexts))]


def spans(mark: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


#: Symbols (bytes or words) from ``first`` on.
SPANS = "array<struct<first:int,count:int>>"
SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))


def span_array(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "count": n} for a, n in own] for own in rows], SPAN_TYPE)


def solve(contexts: DataFrame, measures: tuple[Measure, ...], level: int = 0) -> DataFrame:
    """anchor, context, spans of repeated windows. ``contexts``: anchor, context, kind (which measure), windows, weight,
    piece (bytes); distinct per anchor."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = contexts.groupBy("anchor").agg(F.count("*").alias("n_contexts"))
    sized = materialize(contexts.join(counted, "anchor"))
    last = level == len(measures[0].longer)
    small = F.lit(True) if last else (F.col("n_contexts") <= TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, before = 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("kind", "anchor", "context", "windows", "weight", "piece"))):
                if held and (row[0] != held[0][0] or (row[1] != before and size > SA_BYTES)):
                    yield answer(held)
                    held, size = [], 0
                before = row[1]
                held.append(row)
                size += len(row[5])
        if held:
            yield answer(held)

    def answer(held: list[tuple]) -> pa.RecordBatch:
        kind, anchor, context, windows, weight, piece = zip(*held)
        measure = measures[kind[0]]
        marks = (repeated_passages if measure.by_word else repeated_windows)(list(piece), list(windows), measure.length)
        found = [[(0, n)] if w > 1 else spans(m) for m, n, w in zip(marks, windows, weight)]
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(context, pa.int64()), span_array(found)], ["anchor", "context", "spans"])

    done = sized.where(small).repartition(parts, "anchor").sortWithinPartitions("kind", "anchor", "context").mapInArrow(trimmed(run), f"anchor bigint, context bigint, spans {SPANS}")
    if not last:
        large = sized.where(~small)
        if not large.isEmpty():
            done = done.unionByName(split(large, measures, level))
    return done


def split(large: DataFrame, measures: tuple[Measure, ...], level: int) -> DataFrame:
    """Solve anchors with many contexts through longer anchors inside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("kind").to_numpy()
            for kind in np.unique(kinds):
                own, measure = b.filter(pa.array(kinds == kind)), measures[kind]
                pieces = own.column("piece").to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
                (row, first, n, code, context), words = measured(np.frombuffer(b"".join(pieces), np.uint8), offsets, measure, measure.longer[level])
                cut = cuts_of(pieces, row, first, n, measure.length, words)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(take) for c in ("anchor", "context", "weight", "kind")), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(code.view(np.int64)), pa.array(context.view(np.int64)), pa.array(cut, pa.binary())], ["up_anchor", "up_context", "weight", "kind", "first", "windows", "anchor", "context", "piece"])

    inner = materialize(large.mapInArrow(trimmed(run), "up_anchor bigint, up_context bigint, weight bigint, kind int, first int, windows int, anchor bigint, context bigint, piece binary"))
    distinct = inner.groupBy("anchor", "context").agg(F.first("kind").alias("kind"), F.first("windows").alias("windows"), F.sum("weight").alias("weight"), F.first("piece").alias("piece"))
    if level + 1 == len(measures[0].longer):  # the anchors are whole windows
        found = distinct.select("anchor", "context", F.when(F.col("weight") > 1, F.array(F.struct(F.lit(0).alias("first"), F.col("windows").alias("count")))).otherwise(F.array().cast(SPANS)).alias("spans"))
    else:
        found = solve(distinct, measures, level + 1)
    back = inner.join(found, ["anchor", "context"])
    shifted = F.transform("spans", lambda s: F.struct((s["first"] + F.col("first")).alias("first"), s["count"].alias("count")))
    return back.groupBy(F.col("up_anchor").alias("anchor"), F.col("up_context").alias("context")).agg(F.flatten(F.collect_list(shifted)).alias("spans"))


def cuts_of(texts: list[bytes], row: np.ndarray, first: np.ndarray, n: np.ndarray, length: int, words: Words | None) -> list[bytes]:
    """The bytes of runs of windows; with ``words`` (of all texts) ``first`` and ``n`` count words."""
    if words is None:
        return [texts[r][f : f + k + length - 1] for r, f, k in zip(row.tolist(), first.tolist(), n.tolist())]
    at = np.concatenate([[0], np.cumsum(words.count)])[row] + first
    low, high = words.start[at] - words.offsets[row], words.end[at + n + length - 2] - words.offsets[row]
    return [texts[r][a:z] for r, a, z in zip(row.tolist(), low.tolist(), high.tolist())]


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def repeats(docs: DataFrame, measures: tuple[Measure, ...] = (BYTES,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_key, spans: which bytes or words (kind: place in ``measures``; first, count) of each text repeated windows cover;
    texts without any are left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = as_text(docs, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # a word and the white space after it have two bytes at least
    least = min(2 * m.length - 1 if m.by_word else m.length for m in measures)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offsets in text_chunks(*utf8(b.column("text"))):
                for k, m in enumerate(measures):
                    (at, first, n, code, context), _ = measured(data, offsets, m, m.anchor)
                    take = pa.array(at + row)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("key").take(take), pa.array(np.full(len(at), k, np.int32)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(code.view(np.int64)), pa.array(context.view(np.int64))], ["doc_id", "key", "kind", "first", "windows", "anchor", "context"])

    long_ = own.where(F.octet_length("text") >= least).withColumn("key", text_key(F.col("text"))).select("doc_id", "key", "text")
    scanned = materialize(long_.mapInArrow(trimmed(scan), f"doc_id {kind}, key binary, kind int, first int, windows int, anchor bigint, context bigint"))
    # a table of its own: an aggregate in the join's stage would keep Spark from splitting a hot anchor
    again = materialize(scanned.groupBy("anchor").count().where("count > 1").select("anchor"))
    runs = materialize(scanned.join(again, "anchor", "left_semi"))
    release(scanned, again)
    grouped = materialize(runs.groupBy("anchor", "context").agg(F.count("*").alias("weight"), F.first("kind").alias("kind"), F.first("windows").alias("windows"), F.min(F.struct("doc_id", "key", "first")).alias("at")))
    alone = grouped.groupBy("anchor").agg(F.count("*").alias("n")).where("n = 1").select("anchor")
    single = grouped.join(alone, "anchor", "left_semi").select("anchor", "context", F.array(F.struct(F.lit(0).alias("first"), F.col("windows").alias("count"))).cast(SPANS).alias("spans"))
    wanted = grouped.join(alone, "anchor", "left_anti").select("anchor", "context", "weight", "kind", "windows", F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key"), F.col("at.first").alias("first"))
    lists = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "context", "weight", "kind", "windows", "first")).alias("cuts")).withColumnsRenamed({"doc_id": "_id", "key": "_key"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, cuts in zip((t.encode() for t in b.column("text").to_pylist()), b.column("cuts").to_pylist()):
                for k, m in enumerate(measures):
                    mine = [c for c in cuts if c["kind"] == k]
                    if mine:
                        first, n = (np.array([c[x] for c in mine], np.int64) for x in ("first", "windows"))
                        words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])) if m.by_word else None
                        pieces = cuts_of([text], np.zeros(len(mine), np.int64), first, n, m.length, words)
                        rows += [(c["anchor"], c["context"], c["weight"], k, c["windows"], p) for c, p in zip(mine, pieces)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["anchor", "context", "weight", "kind", "windows", "piece"])

    cuts = long_.join(lists, long_["doc_id"].eqNullSafe(lists["_id"]) & (long_["key"] == lists["_key"])).select("text", "cuts")
    cuts = cuts.withColumn("cuts", F.array_distinct("cuts"))
    pieces = cuts.mapInArrow(trimmed(cut), "anchor bigint, context bigint, weight bigint, kind int, windows int, piece binary")
    found = solve(pieces, measures).unionByName(single)
    found = found.where(F.size("spans") > 0)
    # ``count`` windows cover length - 1 symbols more
    length = F.element_at(F.array(*(F.lit(m.length) for m in measures)), F.col("kind") + 1)
    placed = runs.join(found, ["anchor", "context"]).select("key", F.explode(F.transform("spans", lambda s: F.struct(F.col("kind").alias("kind"), (F.col("first") + s["first"]).alias("first"), (s["count"] + length - 1).alias("count")))).alias("span"))
    return placed.groupBy("key").agg(F.collect_set("span").alias("spans")).withColumnRenamed("key", "text_key")


def merged(found: list[dict] | None, kind: int = 0) -> list[tuple[int, int]]:
    """Disjoint (start, end) of the spans of a measure."""
    out: list[list[int]] = []
    for a, n in sorted((s["first"], s["count"]) for s in found or () if s["kind"] == kind):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strings: Measure = BYTES, passages: Measure = PASSAGES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the removal of repeated ``strings``, and n_passage_words: words that
    lie in repeated ``passages``, which are not removed by that."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                raw, at, left = text.encode(), 0, hashlib.sha256()
                gone = merged(found)
                for a, z in gone:
                    left.update(raw[at:a])
                    at = z
                left.update(raw[at:])
                rows.append((len(raw), sum(z - a for a, z in gone), len(gone), left.hexdigest(), sum(z - a for a, z in merged(found, 1))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    own = docs.select(F.col(id_col).alias("doc_id"), as_text(docs, text_col).alias("text"), text_key(as_text(docs, text_col)).alias("key"))
    found = repeats(own, (strings, passages))
    return own.join(found, own["key"] == found["text_key"], "left").select("doc_id", "text", "spans").mapInArrow(trimmed(run), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint")


def cleaned(docs: DataFrame, measure: Measure = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what the measure finds repeated cut out of the text. A byte span is narrowed to whole characters; a span
    of words goes with the white space between them. ``n_chars``, where there is one, is counted again."""

    @F.pandas_udf("string")
    def without(texts, found):  # noqa: ANN001, ANN202
        out = []
        for text, own in zip(texts, found):
            if own is None or text is None:
                out.append(text)
                continue
            raw, at, left = text.encode(), 0, []
            gone = merged(list(own))
            if measure.by_word:
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                gone = [(int(words.start[a]), int(words.end[z - 1])) for a, z in gone]
            for a, z in gone:
                while a < z and raw[a] & 0xC0 == 0x80:
                    a += 1
                while z < len(raw) and z > a and raw[z] & 0xC0 == 0x80:
                    z -= 1
                left.append(raw[at:a])
                at = z
            out.append(b"".join([*left, raw[at:]]).decode())
        return texts.__class__(out, dtype=object)

    # the row is packed, so its columns may have any name
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), as_text(docs, text_col).alias("text"), text_key(as_text(docs, text_col)).alias("key"))
    found = repeats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), (measure,))
    cut = own.join(found, own["key"] == found["text_key"], "left").select("row", F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(without(F.col("text"), F.col("spans"))).alias("text"))
    new = {text_col: F.col("text"), **({"n_chars": F.length("text").cast("bigint")} if "n_chars" in docs.columns else {})}
    return cut.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read(spark, sf_dir, "documents"))
