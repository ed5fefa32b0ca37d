"""Phrases, piece ids and token alignment against brute force, on texts with nulls, empty and long ones, ties, copies and odd signs."""

import collections
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotline.llm import alignment, common, phrases, pieces

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id long, text string, lang string, `count` string, block int, id string"
SIGNS = ["a", "b", "ab", "Ab", " ", "  ", " ", " ", "\n", "\t", "é", "日", "본", "▁", "<|endoftext|>", "'s", "12", "\x00", "<0x0A>", "🙂", "\x1c", "\x85", " ", ".", "!!", "ß", "́", "  x", "<s>", "　", "\r\n", "word"]


def odd_rows():
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), "clash", 1, "x") for k in range(600)]
    rows += [(600, None, "en", None, None, None), (601, "", None, None, None, None), (602, " ", "und", None, None, None), (None, "hello world", None, None, None, None)]
    return [*rows, rows[5], (603, "long " * 30_000 + "x" * 30_000, "en", None, None, None)]


ROWS = odd_rows()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few hundred bytes, so that dictionaries of many blocks meet."""
    for module, name, size in ((pieces, "BLOCK_BYTES", 300), (alignment, "BLOCK_BYTES", 900), (alignment, "ALIGN_BYTES", 300), (phrases, "BLOCK_BYTES", 300), (pieces, "DECODE_IDS", 50)):
        monkeypatch.setattr(module, name, size)


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_piece_ids_equal_the_library(odd, none, model, small_blocks):
    rows = pieces.decoded(pieces.encoded(odd, pieces.model_path()), pieces.model_path()).collect()
    got = collections.Counter((r.doc_id, tuple(r.ids), r.text) for r in rows)
    want = collections.Counter((k, tuple(ids := model.encode(t or "")), model.decode(ids) if ids else "") for k, t, *_ in ROWS)
    assert got == want
    assert pieces.encoded(none, pieces.model_path()).collect() == []


def test_models_that_cross_markers_are_refused(monkeypatch):
    monkeypatch.setattr(pieces, "MARK", "e")
    with pytest.raises(ValueError, match="cross"):
        pieces.ChunkModel(pieces.model_path())


def plain_alignment(rows, model):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(alignment.paths()[0])
    whole.encode_special_tokens = True
    letters = alignment.byte_letters()
    made, count = [], collections.Counter()
    for k, t, *_ in rows:
        a = whole.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        side = [bytes(letters[c] for c in whole.id_to_token(i)) for i in a], [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or any(b"".join(x) != (" " + t).encode() for x in side):
            made.append((k, [], [], [], ""))
            continue
        at = [{int(e): n for n, e in enumerate(np.cumsum([len(x) for x in s]))} for s in side]
        links, groups, i, j = [], [], 0, 0
        for e in sorted(at[0].keys() & at[1].keys()):
            m, n = at[0][e], at[1][e]
            links.append((a[m], b[n]))
            groups.append(",".join(map(str, a[i : m + 1])) + "|" + ",".join(map(str, b[j : n + 1])))
            i, j = m + 1, n + 1
        count.update(links)
        made.append((k, a, b, links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return collections.Counter((k, len(a), len(b), len(x), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), g) for k, a, b, x, g in made)


def test_alignment_equals_brute_force(odd, none, model, small_blocks):
    got = collections.Counter(map(tuple, alignment.alignments(odd, *alignment.paths()).collect()))
    assert got == plain_alignment(ROWS, model)
    assert alignment.alignments(none, *alignment.paths()).collect() == []
    hashed = alignment.alignments(odd, *alignment.paths(), keep=lambda g: F.length(g)).where("doc_id = 601").collect()
    assert [r.groups for r in hashed] == [0]


def plain_phrases(rows, least, longest):
    total, count = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            count.update((lang, tuple(words[i : i + j])) for j in range(1, longest + 1) for i in range(len(words) - j + 1))
    found = {k: a for k, a in count.items() if a >= least}
    inside = {(lang, p[i:j]) for (lang, p), a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and found[lang, p[i:j]] == a}
    out = set()
    for (lang, p), a in found.items():
        if len(p) > 1 and (lang, p) not in inside:
            score, k = min((1000 * a * total[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
            out.add((lang, " ".join(p), a, found[lang, p[:k]], found[lang, p[k:]], total[lang], score))
    return out


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(9)
    words = ["the", "of", "Red", "fox", "runs", "jumps", "a", "ü", "x.y", "to", "be", "or"]
    fixed = ["the red fox", "to be or of a", "a a a a a a a", "ü ü"]
    rows = [(k, " ".join(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) + rng.choice(["", "", "", ",", "!", "\n", "\t"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und"]), None, None, None) for k in range(200)]
    return [*rows, *ROWS[-3:], rows[7], (901, None, "xx", None, None, None), (902, "a " * 9000, "en", None, None, None)]


@pytest.mark.parametrize("trie", [1_000_000, 40])
def test_collocations_equal_brute_force(spark, none, chatter, trie, small_blocks, monkeypatch):
    monkeypatch.setattr(phrases, "TRIE_PHRASES", trie)
    docs = spark.createDataFrame(chatter, SCHEMA).repartition(3)
    found = phrases.collocations(docs, least=6)
    assert set(map(tuple, found.collect())) == plain_phrases(chatter, 6, 5)
    order = sorted(found.collect(), key=lambda r: (r.lang, -r.score, -r.a, r.phrase.encode()))
    top = [r for k, r in enumerate(order) if sum(x.lang == r.lang for x in order[:k]) < 9]
    assert [(r.lang, r.phrase) for r in sorted(phrases.ranked(found, 9).collect(), key=lambda r: (r.lang, r["rank"]))] == [(r.lang, r.phrase) for r in top]
    assert phrases.ranked(phrases.collocations(none)).collect() == []


def test_only_frequent_phrases_are_put_into_tries(spark, chatter, small_blocks, monkeypatch):
    """What is sent to the tasks and shuffled are phrases that count enough, not all that two of them could make."""
    put = {}

    def noted(own, depth, tries=phrases.tries):
        put[depth] = own.count()
        return tries(own, depth)

    monkeypatch.setattr(phrases, "tries", noted)
    levels, _ = phrases.frequent_phrases(spark.createDataFrame(chatter, SCHEMA).repartition(2), least=6)
    assert put == {k: levels[k - 1].count() for k in (2, 3, 4)} and len(levels) == 5 and put[4] > 0


def test_double_array_accepts_its_phrases_only():
    rng = np.random.default_rng(3)
    for depth in (2, 3, 5):
        own = np.unique(rng.integers(1, 40, (800, depth)).astype(np.int32), axis=0)
        trie = phrases.double_array(own)
        ids = rng.integers(0, 40, 5_000).astype(np.int32)
        ids[100 : 100 + depth] = own[7]
        at, number = phrases.walk(trie, ids, np.arange(len(ids) - depth + 1), depth)
        want = {tuple(x): k for k, x in enumerate(own.tolist())}
        assert {a: n for a, n in zip(at.tolist(), number.tolist())} == {i: want[t] for i in range(len(ids) - depth + 1) if (t := tuple(ids[i : i + depth].tolist())) in want}


def test_spaced_texts_and_ranges():
    import pyarrow as pa

    data, offsets = common.spaced(*common.utf8(pa.array(["ab", None, "", " é"])))
    assert data.tobytes() == " ab  é".encode() and offsets.tolist() == [0, 3, 3, 3, 7]
    assert common.repeated_ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_names_and_notices_of_pages(spark):
    """A name that only sounds like boilerplate keeps its text; a notice on two fifths of a host's pages goes."""
    from slotline.llm import mainhtml

    kept = '<div class="related-work"><p>Our work.</p></div><div class="notice-board"><p>News.</p></div>'
    gone = '<div class="cookie-notice bar">We use</div><div id="comments">bad</div><div class="x ad">buy</div><div class="share-buttons">x</div>'
    notice = "<div><p>The office is closed this week.</p></div>"
    pages = [(k, f"https://one.example/{k}", f"<html><body>{kept}<p>Page {k} tells of {k * k}.</p>{gone}{notice if k < 16 else ''}</body></html>") for k in range(40)]
    rows = mainhtml.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    # what stands on all pages is template, whatever its name; alone on a host it is text
    assert {r.page_id: r.text for r in rows} == {k: f"Page {k} tells of {k * k}." for k in range(40)}
    alone = mainhtml.main_text(spark.createDataFrame(pages[:1], "page_id long, url string, html string")).first()
    assert alone.text == "Our work. News. Page 0 tells of 0. The office is closed this week."
