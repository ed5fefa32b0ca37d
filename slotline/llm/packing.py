"""Best-fit packing of tokenised documents with Martello-Toth dominance reduction (operator 1).

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. There the
reduction fixes sets that provably dominate every other set holding the same piece, and best-fit decreasing places the
rest, both on whole length classes at once. The plan is a list of segments "pieces r0..r1 of length L go to sequences
b.."; the cluster ranks each piece within its length and looks its place up. The plan's size depends on ``capacity``
alone: a class splits at most three groups of sequences, and a sequence holds at most sqrt(2 * capacity) lengths.

Defined results: null or empty text is one piece of the end token; repeated rows and null ids are packed as rows of
their own; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, materialize, read, trimmed

CAPACITY = 2048
CACHE_WORDS = 200_000
ROWS_PER_PART = 20_000
#: Letters whose lower case and composition depend on no neighbour, then signs that never join a word.
WORD_THEN_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*#$|]*)")


class WordTokenizer:
    """Ids of a text as little-endian uint32 bytes, joined from ids of its space-separated chunks.

    Exact where the tokenizer drops white space before it merges, as word_bpe_49k does; chunks that hold
    special tokens are encoded alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.merge = self.inner.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = sorted(set(range(256)).difference(plain))
        #: How byte-level BPE writes bytes: printable ones as themselves, the others from code point 256 on.
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def alone(self, chunk: str) -> bytes:
        return np.array(self.inner.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def together(self, chunks: list[str]) -> Iterator[bytes]:
        for at in range(0, len(chunks), 2000):
            part = chunks[at : at + 2000]
            got = self.inner.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            edges = (4 * np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            yield from (ids[a:b] for a, b in zip(edges, edges[1:]))

    def learn(self, chunks: set[str]) -> None:
        """Latin words go straight to the merges, in lower case and apart from the signs after them."""
        words, match, other = self.words, WORD_THEN_SIGNS.fullmatch, []
        for c in chunks:
            if m := match(c):
                w, signs = m.groups()
                w = w.lower()
                if (ids := words.get(w)) is None:
                    ids = words[w] = self.older.get(w) or self.word(w)
                if signs:
                    if (last := words.get(signs)) is None:
                        last = words[signs] = self.word(signs)
                    ids += last
                self.known[c] = ids
            else:
                other.append(c)
        plain = [c for c in other if "<|" not in c]
        self.known.update(zip(plain, self.together(plain)))
        self.known.update((c, self.alone(c)) for c in set(other).difference(plain))

    def word(self, w: str) -> bytes:
        if not w.isascii():
            w = w.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.merge(w)]).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 32):
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            if len(self.words) > CACHE_WORDS:
                self.older, self.words = self.words, {}
            split = [text.replace("\n", " ").split(" ") for text in texts[at : at + 32]]
            if missing := set().union(*split).difference(self.known):
                self.learn(missing)
            ids = self.known.__getitem__
            for chunks in split:
                yield b"".join(map(ids, chunks))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary uint32) of each document's pieces."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    stop = int(end_id).to_bytes(4, "little")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        for part in parts:
            source, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, ids in enumerate(tokenizer.encode(part.column(1).to_pylist())):
                ids += stop
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    source.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if keep_ids:
                        kept.append(own)
            columns = [part.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("doc_id"), as_text(docs, text_col).alias("text")).mapInArrow(trimmed(cut), schema)


def dominating_sets(count: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Martello-Toth reduction on length classes: (how many, lengths) of sequences fixed for good; lowers ``count``.

    For the longest free piece j with room r beside it: alone if nothing fits; {j, k} if k fills r, or if no two pieces
    fit into r (k: the longest that fits); {j, k, b} if no three fit, k is the longest that fits, b the longest beside k,
    and the smaller of any two that fit is at most b. Each such set dominates every feasible set that holds j.
    """
    fixed, lengths = [], sorted(x for x in count if count[x] > 0)

    def use(x: int, n: int) -> None:
        count[x] -= n
        if not count[x]:
            lengths.pop(bisect_left(lengths, x))

    def longest(room: int, taken: tuple[int, ...]) -> int:
        at = bisect_left(lengths, room + 1) - 1
        while at >= 0 and count[lengths[at]] <= taken.count(lengths[at]):
            at -= 1
        return lengths[at] if at >= 0 else 0

    def smallest(k: int, taken: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for x in lengths:
            out += [x] * min(k, count[x] - taken.count(x))
            if len(out) >= k:
                break
        return out[:k]

    for j in sorted(lengths, reverse=True):
        while count[j]:
            room = capacity - j
            k = longest(room, (j,))
            if not k:
                n, own = count[j], (j,)
            else:
                least = smallest(3, (j,))
                if k == room or sum(least[:2]) > room or len(least) < 2:
                    own = (j, k)
                elif sum(least) > room or len(least) < 3:
                    b = longest(room - k, (j, k))
                    half = next((d for d in reversed(lengths[: bisect_left(lengths, room // 2 + 1)]) if count[d] > (d == j) and longest(room - d, (j, d)) >= d), 0)
                    if not b or half > b:
                        break
                    own = (j, k, b)
                else:
                    break
                n = min(count[x] // own.count(x) for x in own)
            fixed.append((n, own))
            for x in set(own):
                use(x, n * own.count(x))
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on length classes: (how many, lengths in order) of sequences."""
    open_: list[tuple[int, int]] = []
    groups: list[list] = []

    for x in sorted((x for x in count if count[x] > 0), reverse=True):
        left, at = count[x], bisect_left(open_, (x, 0))
        while left:
            if at < len(open_):
                room, g = open_.pop(at)
                n, own = groups[g]
                groups[g] = [0, ()]
            else:
                room, own = capacity, ()
                n = -(-left // (room // x))
            each = room // x
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            left -= full * each + rest
            for many, k in ((full, each), (1 if rest else 0, rest), (n - full - (1 if rest else 0), 0)):
                if many:
                    groups.append([many, own + (x,) * k])
                    if room - k * x:
                        insort(open_, (room - k * x, len(groups) - 1))
            at = bisect_left(open_, (x, 0))
    return [(n, own) for n, own in groups if n]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset) segments for all pieces."""
    count = dict(histogram)
    patterns = dominating_sets(count, capacity) + best_fit(count, capacity)
    used, sequence, out = dict.fromkeys(histogram, 0), 0, []
    for n, own in patterns:
        offset = 0
        for x in sorted(set(own), reverse=True):
            each = own.count(x)
            out.append((x, used[x], used[x] + n * each, each, sequence, offset))
            used[x] += n * each
            offset += each * x
        sequence += n
    return out


def rank_within(df: DataFrame, key: str, row: str, name: str, count: dict[int, int]) -> DataFrame:
    """Number the rows of each ``key`` from 0, in order of a part and of ``row`` (no two rows' values are equal in a part's
    sort but for repeated rows). A key has a part for each ``ROWS_PER_PART`` of its rows, so none needs one task."""
    parts = df.sparkSession.createDataFrame([(x, -(-n // ROWS_PER_PART)) for x, n in count.items()], f"_of {df.schema[key].dataType.simpleString()}, _parts int")
    # one row a length, so at most the capacity
    own = df.join(F.broadcast(parts), F.col(key) == F.col("_of")).withColumn("_part", F.pmod(F.xxhash64(row), F.col("_parts")).cast("int")).drop("_of", "_parts")
    sums = own.groupBy(key, "_part").count()
    before = sums.select(F.col(key), "_part", (F.sum("count").over(W.partitionBy(key).orderBy("_part")) - F.col("count")).alias("_before"))
    local = own.withColumn("_n", F.row_number().over(W.partitionBy(key, "_part").orderBy(row)) - 1)
    return local.join(before, [key, "_part"]).withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table with columns ``length`` and ``_row`` (a key of each row, left out of the result);
    ``pieces`` should be cheap to read twice."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    segments = spark.sparkContext.broadcast(_lookup(plan(histogram, capacity)))
    names = [c for c in pieces.columns if c != "_row"]
    ranked = rank_within(pieces, "length", "_row", "_rank", histogram).select(*names, "_rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "_row")

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segments.value
        for part in parts:
            length, rank = part.column("length").to_numpy(), part.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, each, base, at = table[int(x)]
                k = np.searchsorted(first, rank[own], "right") - 1
                step = rank[own] - first[k]
                sequence[own] = base[k] + step // each[k]
                offset[own] = at[k] + step % each[k] * x
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(place), f"{kinds}, sequence_id bigint, offset bigint")


def _lookup(segments: list[tuple[int, int, int, int, int, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    by: dict[int, list] = {}
    for x, first, _, each, base, at in segments:
        by.setdefault(x, []).append((first, each, base, at))
    return {x: tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) for x, rows in by.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col)
    return pack(materialize(pieces.withColumn("_row", F.monotonically_increasing_id())), capacity)  # written: the keys stay


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
