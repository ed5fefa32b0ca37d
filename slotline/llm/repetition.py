"""Repetition coverage: characters inside duplicated word n-grams and lines (operator 3).

Per text: rolling hashes of word runs of several lengths, a sort to find the repeated ones, and the share of the text's
word characters that they cover. Texts are hashed many at a time in numpy; nothing leaves a text, so there is no shuffle.

Defined results: null or empty text has no words and fails the base rules; repeated rows and null ids give a row each;
an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, Words, as_text, batches, mix, read, trimmed

#: Most share of word characters in repeated runs of n words, and in lines that repeat an earlier line.
MOST_IN_GRAMS = {5: 0.50, 8: 0.45, 12: 0.45}
MOST_IN_LINES = 0.30
MIN_WORDS = 50
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in "#*$%&|<>"]] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    own = keys[order]
    same = own[1:] == own[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def covered(words: Words, n: int) -> np.ndarray:
    """Which words lie in a run of ``n`` words that occurs more than once in its text."""
    at, key = words.grams(n)
    at = at[repeated(mix(key + mix(words.row[at].astype(U))))]
    step = np.zeros(len(words.hash) + 1, np.int64)
    step[: len(step) - n] += np.bincount(at, minlength=len(step) - n)[: len(step) - n] if len(step) > n else 0
    step[n:] -= np.bincount(at, minlength=len(step) - n)[: len(step) - n] if len(step) > n else 0
    return np.cumsum(step)[:-1] > 0


def measure(words: Words, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    data, offsets, rows = words.data, words.offsets, words.rows
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[words.end] - points[words.start]
    by_row = lambda weights: np.bincount(words.row, weights, minlength=rows).astype(np.int64)
    signs = np.concatenate([[0], np.cumsum(SIGNS[data])])
    out = {"n_words": words.count.astype(np.int64), "word_chars": by_row(chars), "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]]}

    breaks = np.flatnonzero(data == 10)
    per_row = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=rows) + 1
    start, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    line_row = np.repeat(np.arange(rows), per_row)
    before = np.concatenate([[0], np.cumsum(chars)])
    first_word = np.searchsorted(words.start, start)
    size = before[np.searchsorted(words.start, end)] - before[first_word]
    keep = np.flatnonzero(size > 0)
    key = mix(words.rolling.of(start, end) + mix((end - start).astype(U)))[keep]
    _, first = np.unique(mix(key + mix(line_row[keep].astype(U))), return_index=True)
    later = np.ones(len(keep), bool)
    later[first] = False
    again = keep[later]
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_row[again], size[again], minlength=rows).astype(np.int64)

    out["n_repeat_words"] = by_row(covered(words, 3))
    for n in lengths:
        out[f"chars_in_{n}_grams"] = by_row(covered(words, n) * chars)
    return out


def repetition(docs: DataFrame, most_in_grams: dict[int, float] = MOST_IN_GRAMS, most_in_lines: float = MOST_IN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts, characters covered by each kind of repeat, base_failed and kept."""
    lengths = tuple(sorted(most_in_grams))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"chars_in_{n}_grams" for n in lengths)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, end, words in batches(part):
                got = measure(words, lengths)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(row, end - row), *(pa.array(got[n]) for n in numbers)], ["doc_id", *numbers])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in numbers)
    counted = docs.select(F.col(id_col).alias("doc_id"), as_text(docs, text_col).alias("text")).mapInArrow(trimmed(run), schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.col("dup_line_chars") <= most_in_lines * F.col("word_chars")
    for n, most in most_in_grams.items():
        fine &= F.col(f"chars_in_{n}_grams") <= most * F.col("word_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read(spark, sf_dir, "documents"))


def _gram_sql(n: int) -> str:
    return f"""g{n} AS (SELECT d, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS g FROM (SELECT d, w, unnest(range(1, len(w) - {n - 2})) AS i FROM t WHERE len(w) >= {n})),
r{n} AS (SELECT d, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY d, g) > 1),
c{n} AS (SELECT d, count(*) AS n, sum(length(x)) AS chars FROM (SELECT DISTINCT r.d, r.i + k AS i FROM r{n} r, range(0, {n}) q(k)) JOIN v USING (d, i) GROUP BY d)"""


ORACLE = (
    r"""WITH t AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT d, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
n AS (SELECT d, sum(length(x)) AS word_chars FROM v GROUP BY d),
l AS (SELECT d, line, row_number() OVER (PARTITION BY d, line) AS k FROM (SELECT d, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT d, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM l WHERE k > 1 GROUP BY d),
"""
    + ",\n".join(map(_gram_sql, (3, *MOST_IN_GRAMS)))
    + r""",
f AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(m.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(m.chars, 0) AS BIGINT) AS dup_line_chars,
  CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words, """
    + ", ".join(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS chars_in_{n}_grams" for n in MOST_IN_GRAMS)
    + " FROM t LEFT JOIN n USING (d) LEFT JOIN m USING (d) "
    + " ".join(f"LEFT JOIN c{n} USING (d)" for n in (3, *MOST_IN_GRAMS))
    + f""")
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND dup_line_chars <= {MOST_IN_LINES} * word_chars AND """
    + " AND ".join(f"chars_in_{n}_grams <= {m} * word_chars" for n, m in MOST_IN_GRAMS.items())
    + " AS kept FROM f"
)
