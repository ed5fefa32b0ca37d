"""Aligning two tokenizers' tokens by the bytes they stand for (operator 13).

Per block of texts: distinct chunks (a space and what follows) are tokenised once by both vocabularies, and from there
all is Arrow arrays. Token ids are lists per document; they are flattened with their parents, byte lengths are summed
segment by segment, and (document, byte end) keys of one side meet those of the other in a hash join: where both end, a
group ends, and the two tokens that end there are linked. Links are counted per block by ``Table.group_by`` and the
blocks' counts are summed by Spark, which also finds each B id's highest. A block keeps its links as codes into its own
distinct pairs; counts come back to the block once a pair, not once a link.

Defined results: null and empty texts, and texts that tokens do not give back byte by byte, have no tokens, zeros and an
empty ``groups``; repeated rows count each time; null ids are rows of their own; an empty table gives no rows; other columns are
ignored. Ids must be below 2**31.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MARK, as_text, block_ids, materialize, read, repeated_ranges, spaced, string_array, text_chunks, trimmed, utf8

#: Bytes of texts whose distinct chunks are tokenised together, and of those that are aligned together: a block, with its own
#: distinct pairs.
BLOCK_BYTES, ALIGN_BYTES = 1 << 23, 1 << 21


def byte_letters() -> dict[str, int]:
    """How byte-level BPE writes bytes: printable ones as themselves, the others in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokens:
    """Byte-level BPE of a tokenizers file; the merges' order is the ids' order, so its vocabulary serves as ranks."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters, added = byte_letters(), {x["content"] for x in whole["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): k for token, k in whole["model"]["vocab"].items() if token not in added}
        self.inner = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]
        self.bytes = {k: x for x, k in ranks.items()}

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return [self.inner.encode_ordinary(c) for c in chunks]


class PieceTokens:
    """Pieces of a sentencepiece model, which puts a space first itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.inner.get_piece_size()
        own = [bytes([int(p[3:5], 16)]) if self.inner.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(map(self.inner.id_to_piece, range(n)))]
        self.bytes, self.size = dict(enumerate(own)), np.array([len(x) for x in own])
        self.mark = [self.inner.piece_to_id(MARK)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        ids = self.inner.encode([c[1:] for c in chunks], num_threads=1)
        return [own if len(c) > 1 else self.mark for c, own in zip(chunks, ids)]


def aligned_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that both tokenizers cut there, too: at texts' first bytes, and at a space after a printable
    ASCII sign or a two-byte letter, so that no run of white space of any kind is cut."""
    first = data == 0x20
    first[0:1] = False
    first[1:] &= (data[:-1] > 0x20) & (data[:-1] < 0x7F) | (data[:-1] >= 0x80) & np.concatenate([[False], (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)])
    first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(first)


class Chunks:
    """Distinct chunks of a block with the ids of one tokenizer, flat: ``ids[first[c]:first[c] + count[c]]``."""

    def __init__(self, tokens: ByteTokens | PieceTokens, chunks: list[str], raw: list[bytes]) -> None:
        found = tokens.segment(chunks)
        self.count = np.array([len(x) for x in found], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.ids = np.fromiter(chain.from_iterable(found), np.int32, int(self.count.sum()))
        own = tokens.bytes
        self.same = np.fromiter((b"".join(map(own.__getitem__, x)) == b for x, b in zip(found, raw)), bool, len(raw))

    def lists(self, codes: np.ndarray, edges: np.ndarray) -> pa.ListArray:
        """The ids of documents whose chunks are ``codes[edges[i]:edges[i + 1]]``."""
        count = self.count[codes]
        ends = np.concatenate([[0], np.cumsum(count)])[edges]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.ids[repeated_ranges(self.first[codes], count)], pa.int32()))


def token_ends(lists: pa.ListArray, size: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Per token: the key of (document, byte end), and the document."""
    parents = pc.list_parent_indices(lists).cast(pa.int64())
    sums = pc.cumulative_sum(size.take(pc.list_flatten(lists)))
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums]).take(lists.offsets[:-1].cast(pa.int64()))
    return pc.add(pc.shift_left(parents, 40), pc.subtract(sums, before.take(parents))), parents


def joined_ids(lists: tuple[pa.ListArray, pa.ListArray], cuts: tuple[np.ndarray, np.ndarray], names: tuple[pa.Array, pa.Array]) -> pa.Array:
    """Per document ``a1,a2|b1;a3|b2,b3``. ``cuts``: the tokens of either side that end groups; ``names``: of each side, its ids
    followed by a comma, then by what ends a group's side, then (B) by nothing, for the last of a document."""
    flat = [x.flatten().to_numpy() for x in lists]
    last, group = [], []
    for ids, cut in zip(flat, cuts):
        mark = np.zeros(len(ids), bool)
        mark[cut] = True
        last.append(mark)
        group.append(np.cumsum(mark) - mark)
    place = [np.arange(len(flat[0])) + np.concatenate([[0], cuts[1] + 1])[group[0]], np.arange(len(flat[1])) + np.append(cuts[0] + 1, len(flat[0]))[group[1]]]
    form = [ids * 3 + mark for ids, mark in zip(flat, last)]
    ends = lists[1].offsets.to_numpy()
    form[1][ends[1:][ends[1:] > ends[:-1]] - 1] += 1
    spelled = np.empty(len(flat[0]) + len(flat[1]), np.int64)
    spelled[place[0]], spelled[place[1]] = form[0], form[1] + len(names[0])
    edges = (lists[0].offsets.to_numpy().astype(np.int64) + ends).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), pa.concat_arrays(names).take(pa.array(spelled))), "")


def spelled(n: int, ends: tuple[str, str, str]) -> pa.Array:
    return pa.array([f"{k}{e}" for k in range(n) for e in ends], pa.string())


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows: block, doc_id, n_a, n_b, n_groups, groups, links (int32 codes) of a document; block, code, a, b, n of
    a block's distinct links."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sides = block_ids(), (ByteTokens(byte_path), PieceTokens(piece_path))
        sizes = [pa.array(s.size, pa.int64()) for s in sides]
        names = spelled(len(sizes[0]), (",", "|", "")), spelled(len(sizes[1]), (",", ";", ""))
        for batch in batches_:
            doc_id = batch.column(0)
            for row, _, data, offsets in text_chunks(*utf8(batch.column(1)), BLOCK_BYTES):
                data, offsets = spaced(data, offsets)
                start = aligned_starts(data, offsets)
                coded = string_array(data, np.append(start, len(data))).dictionary_encode()
                codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                raw = [w.encode() for w in words]
                found = [Chunks(s, words, raw) for s in sides]
                good = found[0].same & found[1].same
                for at, end, _, own in text_chunks(data, offsets, ALIGN_BYTES):
                    edges = np.searchsorted(start, own + offsets[at])
                    part = codes[edges[0] : edges[-1]]
                    edges = edges - edges[0]
                    # a document with a chunk that its tokens do not give back has no tokens
                    wrong = np.concatenate([[0], np.cumsum(~good[part])])[edges]
                    size = np.where(np.diff(wrong) > 0, 0, np.diff(edges))
                    part, edges = part[repeated_ranges(edges[:-1], size)], np.concatenate([[0], np.cumsum(size)])
                    yield from one_block(next(ids), doc_id.slice(row + at, end - at), [f.lists(part, edges) for f in found], sizes, names)
                    pa.default_memory_pool().release_unused()

    def one_block(block: int, doc_id: pa.Array, lists: list[pa.ListArray], sizes: list[pa.Array], names: tuple[pa.Array, pa.Array]) -> Iterator[pa.RecordBatch]:
        n = len(doc_id)
        (a_end, _), (b_end, _) = (token_ends(x, s) for x, s in zip(lists, sizes))
        a, b = (pa.table({"end": e, name: pa.array(np.arange(len(e)))}) for e, name in ((a_end, "a"), (b_end, "b")))
        both = a.join(b, "end", join_type="inner", use_threads=False).sort_by("a")
        cuts = both.column("a").to_numpy(), both.column("b").to_numpy()
        first = np.searchsorted(cuts[0], lists[0].offsets.to_numpy())
        pair = pc.bit_wise_or(pc.shift_left(lists[0].flatten().take(both.column("a")).cast(pa.int64()), 32), lists[1].flatten().take(both.column("b")).cast(pa.int64()))
        pairs = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([("pair", "count")])
        links = pc.index_in(pair, pairs.column("pair")).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int32) if len(pair) else np.zeros(0, np.int32)
        own = [
            *(pa.array(np.diff(x.offsets.to_numpy()), pa.int64()) for x in lists), pa.array(np.diff(first), pa.int64()), joined_ids(lists, cuts, names),
            pa.array([links[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), doc_id, *own, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], NAMES)
        m, key = len(pairs), pairs.column("pair").to_numpy()
        rest = [pa.array(np.arange(m, dtype=np.int32)), pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pairs.column("pair_count").combine_chunks()]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.nulls(m, doc_id.type), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())), *rest], NAMES)

    own = docs.select(F.col(id_col).alias("doc_id"), as_text(docs, text_col).alias("text"))
    return own.mapInArrow(trimmed(run), f"block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups string, links binary, code int, a int, b int, n bigint")


NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups", "links", "code", "a", "b", "n"]


def alignments(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``keep`` of the text ``a1,a2|b1;a3|b2,b3``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    made = aligned_blocks(docs, byte_path, piece_path, id_col, text_col)
    rows = materialize(made.withColumn("groups", F.when(F.col("links").isNotNull(), keep(F.col("groups")))))
    own, pairs = rows.where("links is not null").drop("code", "a", "b", "n"), rows.where("links is null").select("block", "code", "a", "b", "n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = materialize(counts)
    best = counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    back = pairs.join(best, ["a", "b"]).select(F.col("block").alias("of"), "code", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups"]

    def sums(_key: tuple, docs_: pa.Table, found: pa.Table) -> pa.Table:
        raw = docs_.column("links").to_pylist()
        links = np.frombuffer(b"".join(raw), np.int32)
        edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
        out = {"n_links": np.diff(edges)}
        for name, column in (("n_best", "best"), ("count_sum", "count")):
            value = np.zeros(len(found) + 1, np.int64)
            value[found.column("code").to_numpy()] = found.column(column).to_numpy()
            out[name] = np.diff(np.concatenate([[0], np.cumsum(value[links])])[edges])
        table = docs_.select(names)
        for name, value in out.items():
            table = table.append_column(name, pa.array(value, pa.int64()))
        return table

    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups {rows.schema['groups'].dataType.simpleString()}, n_links bigint, n_best bigint, count_sum bigint"
    return own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(sums, schema).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    return alignments(read(spark, sf_dir, "documents"), *paths(), keep=digest).withColumnRenamed("groups", "groups_sha256")
