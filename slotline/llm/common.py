"""Helpers that several operators share: a numpy word kernel over Arrow text, and tables written to the shared folder.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so words never depend on Unicode tables.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * BASE)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least; kept for the next call."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(m, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


class RollingHash:
    """Hash of any range of a buffer of bytes, or of 64-bit codes: prefix sums of code * BASE**-i, brought back to exponent 0."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((BYTE_CODE[data] if data.dtype == np.uint8 else data) * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``size`` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of several texts in one buffer: ``start``, ``end``, ``row`` and ``hash`` arrays in text order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> None:
        self.data = data = FOLD[data] if fold else data
        self.offsets, self.rows = offsets, len(offsets) - 1
        space = IS_SPACE[data]
        first = ~space
        last = first.copy()
        full = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        head_word, tail_word = first[heads], last[tails]
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        first[heads], last[tails] = head_word, tail_word
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.rolling = RollingHash(data)
        self.hash = mix(self.rolling.of(self.start, self.end))
        self.count = np.bincount(self.row, minlength=self.rows)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of ``n`` words within one text."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.row[:k] == self.row[n - 1 :])
        h = self.hash[at]
        for j in range(1, n):
            h = h * BASE + self.hash[at + j]
        return at, mix(h)


def batches(table: pa.RecordBatch, column: str = "text", fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over a record batch."""
    for row, end, data, offsets in text_chunks(*utf8(table.column(table.schema.get_field_index(column)))):
        yield row, end, Words(data, offsets, fold)


def runs(parts: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of equal ``column`` together, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        keys = part.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(column)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, returning freed memory at its end: Spark keeps Python workers, idle ones too, from one stage to the next."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches_)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; under a folder of our own where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-slotline-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/slotline-{uuid.uuid4().hex}"


_folders: dict[int, str] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _folders[id(back)] = path
    return back


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` as ``materialize`` writes it, but in buckets of ``column``: what groups by it later needs no shuffle of these rows."""
    spark, path, name = df.sparkSession, shared_folder(df.sparkSession), f"slotline_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    back = spark.table(name)
    back.schema  # noqa: B018  resolved now; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    _folders[id(back)] = path
    return back


def release(*written: DataFrame) -> None:
    """Delete the folders of materialized tables that no later plan reads; where the file system is unknown here they stay."""
    for df in written:
        if path := _folders.pop(id(df), None):
            with contextlib.suppress(OSError, pa.ArrowInvalid, NotImplementedError):
                system, inside = fs.FileSystem.from_uri(path)
                system.delete_dir(inside)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_text(df: DataFrame, column: str):
    """The text column as string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


BLOCK_BYTES = 1 << 24
MARK = "▁"


def block_ids() -> Iterator[int]:
    """Ids of the blocks of rows that one task makes, apart from those of other tasks."""
    at = TaskContext.get()
    first = (at.partitionId() if at else 0) << 32
    yield from itertools.count(first)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each with a space before it; empty ones stay empty."""
    size = np.diff(offsets)
    new = np.concatenate([[0], np.cumsum(size + (size > 0))])
    out, own = np.full(int(new[-1]), 0x20, np.uint8), np.ones(int(new[-1]), bool)
    own[new[:-1][size > 0]] = False
    out[own] = data
    return out, new


def string_array(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Strings ``data[edges[i]:edges[i + 1]]``."""
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def repeated_ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[0], .., start[0] + size[0] - 1, start[1], ..`` in one array."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


#: Level of compression; the byte that ends a chunk in a dictionary, which no UTF-8 text holds.
LEVEL, END = 3, b"\xff"


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as compressed planes of their bytes."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + (pa.Codec("zstd", LEVEL).compress(planes.tobytes(), asbytes=True) if len(values) else b"")


def loosened(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def dealt_dictionary(words: pa.Array, n: np.ndarray, parts: int, salt: bytes = b"") -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, bytes]]]:
    """A block's dictionary dealt to parts by hash: the code of each word, and of each part that has words the counts and the
    (part, words, each ended by END). A code is a word's place in its part times ``parts``, plus the part. Near in the alphabet
    compresses well, frequent first makes small codes: places go by frequency in powers of two, then by letters."""
    raw = [w.encode() for w in words.to_pylist()]
    start = zlib.crc32(salt)
    part = np.fromiter((zlib.crc32(w, start) for w in raw), np.uint32, len(raw)).astype(np.int64) % parts
    rank = np.empty(len(raw), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(raw))
    order = np.lexsort((rank, -np.log2(n).astype(np.int64), part))
    cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
    code = np.empty(len(raw), np.int64)
    code[order] = (np.arange(len(order)) - np.repeat(cuts[:-1], np.diff(cuts))) * parts + part[order]
    own = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    return code, [n[x] for x in own], [(int(part[x[0]]), b"".join(raw[k] + END for k in x.tolist())) for x in own]
