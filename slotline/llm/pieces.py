"""Encoding with a sentencepiece model, and decoding, over a table of distinct chunks (operator 12).

Where no piece holds a whitespace marker after another sign, no merge crosses the place before a marker that follows
another sign. There a text is cut into chunks (markers, then a word). A block of texts keeps its chunks as codes into the
block's own dictionary; the dictionaries are dealt by hash of the chunk, so equal chunks of all blocks meet in one task,
where each is segmented once; the ids go back to their blocks, and codes by position become ids. No row is made for an
occurrence of a word: what is shuffled are dictionaries and codes, both compressed. A code is a chunk's place in its
part of the dictionary (frequent ones first) times the number of parts, plus the part, so it needs no table to find it.

Defined results: null or empty text has no ids and decodes to the empty text; U+2581 in a text is a marker, as in the
library; repeated rows and null ids are rows of their own; an empty table gives no rows; other columns are ignored.
A model whose pieces cross markers, or that changes texts before it cuts them, is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import END, LEVEL, MARK, as_text, block_ids, bucketed, dealt_dictionary, loosened, read, repeated_ranges, spaced, squeezed, string_array, text_chunks, trimmed, utf8

#: Bytes of texts that share a dictionary: the more, the smaller the dictionaries are together.
BLOCK_BYTES = 3 << 23
#: Texts of about so many ids are decoded at a time.
DECODE_IDS = 1 << 20


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkModel:
    """A sentencepiece model that segments chunks, each beginning with a space in the marker's place."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in self.inner.id_to_piece(k).lstrip(MARK) for k in range(self.inner.get_piece_size())):
            raise ValueError("the model has pieces that cross whitespace markers")
        probe = "ﬁ  Å\t① "
        if self.inner.decode(self.inner.encode(probe)) != probe:
            raise ValueError("the model changes texts before it cuts them")
        self.mark = [self.inner.piece_to_id(MARK)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The library puts the first marker itself; a marker alone is a piece."""
        ids = self.inner.encode([c[1:] for c in chunks], num_threads=1)
        return [own if len(c) > 1 else self.mark for c, own in zip(chunks, ids)]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at a space that no space precedes, and at each text's first byte."""
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(first)


def coded_blocks(docs: DataFrame, parts: int, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows: block, doc_ids, sizes (chunks of each) and codes of some documents; block, part, words (compressed,
    each ended by a byte that no text has, in order of their codes) and size (its length) of a dictionary."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = block_ids()
        for batch in batches_:
            doc_id = batch.column(0)
            for row, end, data, offsets in text_chunks(*utf8(batch.column(1)), BLOCK_BYTES):
                yield from one_block(next(ids), doc_id.slice(row, end - row), *spaced(data, offsets))

    def one_block(block: int, doc_id: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = chunk_starts(data, offsets)
        coded = string_array(data, np.append(start, len(data))).dictionary_encode()
        first = coded.indices.to_numpy()
        code, _, bags = dealt_dictionary(coded.dictionary, np.bincount(first, minlength=len(coded.dictionary)), parts)
        edges = np.searchsorted(start, offsets)
        own = pa.ListArray.from_arrays(pa.array([0, len(doc_id)], pa.int32()), doc_id)
        yield rows(block, doc_id.type, own, [squeezed(np.diff(edges))], [squeezed(code[first])], None, None, None)
        yield rows(block, doc_id.type, None, None, None, [p for p, _ in bags], [pa.Codec("zstd", LEVEL).compress(x, asbytes=True) for _, x in bags], [len(x) for _, x in bags])

    def rows(block: int, id_type: pa.DataType, *columns: object) -> pa.RecordBatch:
        n = len(columns[0] if columns[0] is not None else columns[-1])
        types = pa.list_(id_type), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()
        made = [pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *made], ["block", "doc_ids", "sizes", "codes", "part", "words", "size"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(as_text(docs, text_col), MARK, " ").alias("text"))
    return own.mapInArrow(trimmed(run), f"block bigint, doc_ids array<{kind}>, sizes binary, codes binary, part int, words binary, size bigint")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) as the library encodes each text, without begin and end ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(coded_blocks(docs, parts, id_col, text_col), "block", parts)

    def segment(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = ChunkModel(path), {}
        for batch in batches_:
            sizes, found = [], []
            for raw, size in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = pa.decompress(raw, size, "zstd", asbytes=True).split(END)[:-1]
                new = list(set(words).difference(known))
                known.update((w, np.array(x, np.int32).tobytes()) for w, x in zip(new, model.segment([w.decode() for w in new])))
                own = [known[w] for w in words]
                sizes.append(squeezed(np.array([len(x) // 4 for x in own])))
                found.append(squeezed(np.frombuffer(b"".join(own), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(sizes, pa.binary()), pa.array(found, pa.binary())], ["of", "part", "size", "ids"])

    words = rows.where("part is not null").select("block", "words", "size", "part").repartitionByRange(parts, "part")
    segments = words.mapInArrow(trimmed(segment), "of bigint, part int, size binary, ids binary")

    def join_back(_key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        size = [loosened(x) for x in found.column("size").to_pylist()]
        flat = np.concatenate([np.zeros(0, np.int32), *(loosened(x).astype(np.int32) for x in found.column("ids").to_pylist())])
        at = [p + parts * np.arange(len(x)) for p, x in zip(found.column("part").to_pylist(), size)]
        first, length = (np.zeros(max((int(x[-1]) for x in at), default=-1) + 1, np.int64) for _ in range(2))
        if at:
            size, at = np.concatenate(size), np.concatenate(at)
            first[at], length[at] = np.cumsum(size) - size, size
        ids, count = [], []
        for raw, sizes in zip(own.column("codes").to_pylist(), own.column("sizes").to_pylist()):
            codes, edges = loosened(raw), np.concatenate([[0], np.cumsum(loosened(sizes))])
            ids.append(flat[repeated_ranges(first[codes], length[codes])])
            count.append(np.diff(np.concatenate([[0], np.cumsum(length[codes])])[edges]))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(count))])
        doc_id = own.column("doc_ids").combine_chunks().flatten()
        return pa.table({"doc_id": doc_id, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))})

    own = rows.where("part is null").select("block", "doc_ids", "sizes", "codes")
    return own.groupBy("block").cogroup(segments.groupBy("of")).applyInArrow(join_back, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` plus text: what the library decodes from ``ids``; null ids count as none."""
    names = rows.columns
    if "text" in names:
        raise ValueError("rows already have a column text")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches_:
            model = model or ChunkModel(path).inner
            ids, at = batch.column(names.index("ids")), 0
            edges = ids.offsets.to_numpy()
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + DECODE_IDS, "right")) - 1)
                text = [model.decode(x) if x else "" for x in ids.slice(at, end - at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, pa.array(text, pa.string())], [*names, "text"])
                at = end

    return rows.mapInArrow(trimmed(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(read(spark, sf_dir, "documents"), model_path()), model_path())
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
