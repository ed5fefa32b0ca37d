"""Operators against brute force on small fixtures that hold nulls, empty and long texts, ties, copies and clashing columns."""

import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotline.llm import hamming, lmscore, mainhtml, mixing, neardup, packing, repetition, substrings, toxicity, urlrules
from slotline.llm.suffixarray import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(7)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    base = prose(200)
    words = base.split()
    texts = [None, "", "   ", "one two", base, base, base, prose(9000), "aaaa " * 500, "ü" * 900, "x\n" * 600, base + " " + prose(60), prose(70) + " " + base]
    for k in range(12):
        own = list(words)
        for _ in range(k):
            own[rng.randrange(len(own))] = rng.choice(VOCAB)
        texts.append(" ".join(own))
    texts += [prose(rng.randint(1, 300)) for _ in range(60)]
    rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 3}", 0, "clash") for k, t in enumerate(texts)]
    return [*rows, (None, "null id " + prose(60), None, None, None, None), (4, base, "en", "s1", 0, "repeated row")]


DOCS = corpus()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `count` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array_equals_sort():
    for _ in range(300):
        s = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(1, 40))]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_packing(docs, none):
    inner = packing.WordTokenizer(packing.tokenizer_path()).inner
    strange = "Don't <|endoftext|> ÀÉ é ΑΣ 12,5 x\ty\u00a0z \u0301a İ!!"
    assert b"".join(packing.WordTokenizer(packing.tokenizer_path()).encode([strange])) == np.array(inner.encode(strange, add_special_tokens=False).ids, "<u4").tobytes()
    got = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    want = collections.Counter()
    for k, t, *_ in DOCS:
        ids = [*inner.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[k, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(none, packing.tokenizer_path()).count() == 0


def test_packing_plan_uses_every_piece():
    for _ in range(200):
        sizes = collections.Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 60)))
        used = collections.Counter()
        for x, first, end, each, _, _ in packing.plan(dict(sizes), 30):
            used[x] += end - first
        assert used == sizes


def test_toxicity(spark, none):
    bad = ["scumbag", "idiotic", "vermin"]
    rows = []
    for k in range(900):
        words = prose(60).split()
        toxic = k % 6 == 0
        if toxic:
            for w in bad:
                words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words), "en", "s", 0, "", int(toxic)))
    own = spark.createDataFrame(rows, SCHEMA + ", toxic int")
    labels = own.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    model = toxicity.fit(own, labels)
    assert {t for t, _ in model.terms} >= set(bad)
    got = toxicity.predictions(own, labels).join(own, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.99 * len(got)
    some = spark.createDataFrame([(1, "you scunbag idiotc vermin"), (2, 'he said "scumbag" then'), (3, None), (4, "")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(some, model).collect()}
    assert score[1] > 0.5 > score[2] and score[3] == score[4] < 0.5
    assert toxicity.predictions(own, labels.where("false")).where("score > 0").count() == 0
    assert toxicity.score(none, model).count() == 0


def test_toxicity_of_misspelled_terms_only(spark):
    bad = ["scumbag", "pathetic", "vermin", "moron", "dolt"]
    rows = []
    for k in range(900):
        words = prose(60).split()
        if k % 6 == 0:
            for w in bad:
                words.insert(rng.randrange(len(words)), w)
        elif k < 300:
            words.insert(rng.randrange(len(words)), "oron")
        rows.append((k, " ".join(words), int(k % 6 == 0)))
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(own, own.select("doc_id", "toxic"))
    toxic = ["you scunbag and verrmin", "p4thetic sc*mbag", "ver-min, m0ron", "d0lt sc0mbag", "scumb@g/verm1n!"]
    clean = ["an oron here", "a bolt, a colt", "don't 12.5 x_y e-mail", None]
    some = spark.createDataFrame([*enumerate(toxic), *enumerate(clean, 100)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(some, model).collect()}
    assert all((s >= 0.5) == (k < 100) for k, s in score.items()), score
    m = toxicity.TermAutomaton([("idio", True), ("scum", False), ("scumbag", False)], [("idiotic", 0)])
    assert [m.match(w) for w in ("idiotic", "idotic", "sc*m", "scam", "scumbg", "scumm", "$cum", "scu")] == [(0, 0), (1, 0), (1, 1), None, (1, 2), None, (1, 1), None]


def test_automaton_is_one_edit():
    def near(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d, p = [i + 1], d
            for j, y in enumerate(b):
                d.append(min(d[j] + 1, p[j + 1] + 1, p[j] + (x != y)))
        return d[-1]

    m = toxicity.TermAutomaton([("abcde", False), ("bcdeab", False), ("ab", False)])
    for _ in range(4000):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
        want = min([near(w, t) for t in ("abcde", "bcdeab")] + [0 if w == "ab" else 9])
        assert (m.match(w) or (9,))[0] == (want if want <= 1 else 9), w


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        d, p = [i + 1], d
        for j, y in enumerate(b):
            d.append(min(d[j] + 1, p[j + 1] + 1, p[j] + (x != y)))
    return d[-1]


def brute_match(model, word):
    """Nearest term by plain edit distance: (edits, term) or None."""
    plain = [(t, k) for k, (t, stem) in enumerate(model.terms) if not stem] + list(model.forms)
    near = [(0, k) for t, k in plain if t == word]
    for t, k in plain:
        if t != word and distance(word, t) == 1:
            signs = [i for i, c in enumerate(word) if not c.isalpha()]
            by_sign = len(word) >= len(t) and any(word[:i] + word[i + 1 :] == (t if len(word) > len(t) else t[:i] + t[i + 1 :]) for i in signs)
            if len(t) >= 5 or (len(t) == 4 and by_sign):
                near.append((1, k))
    stems = [k for k, (t, stem) in enumerate(model.terms) if stem and word.startswith(t)]
    best = min(near, default=None)
    return (0, stems[0]) if stems and not (best and best[0] == 0) else best


def brute_score(model, text):
    text, places = (text or "").lower(), []
    for m in toxicity.WRITTEN.finditer(text):
        parts = [(p.start(), p.end(), *got) for p in toxicity.TERM.finditer(m[0]) if (got := brute_match(model, p[0]))]
        whole = brute_match(model, m[0])
        if m[0].isalpha():
            parts = [(0, len(m[0]), *whole)] if whole else []
        elif any(p[2] == 0 for p in parts):
            parts = [p for p in parts if p[2] == 0]
        elif whole:
            parts = [(0, len(m[0]), *whole)]
        places += [(m.start() + a, m.start() + b, e, k) for a, b, e, k in parts]
    best = {}
    for i, (a, b, e, k) in enumerate(places):
        before, after = text[max(0, a - 80) : a].rpartition("\n")[2], text[b : b + 80].partition("\n")[0]
        in_quotes = any((before.count(x) % 2 if x == y else before.rfind(x) > before.rfind(y)) and y in after for x, y in toxicity.QUOTES) or any(w in toxicity.REPORTING for w in toxicity.TERM.findall(before)[-4:])
        w = model.quoted[k] if in_quotes and not e else model.plain[k]
        if e:
            w = model.surfaces.get(text[a:b], model.plain[k] * (1 - 2 / max(4, b - a)))
            w = min(w, 0.1 * w) if in_quotes else w
        if w > 0:
            w *= 1 + 0.1 * min(3, sum(abs(c - a) <= 80 for c, *_ in places[max(0, i - 4) : i + 5]) - 1)
        best[k] = max(best.get(k, -99.0), w)
    logit = model.prior + sum(best.values()) if best else model.none
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, logit)))) if model.terms else 0.0


def test_toxicity_equals_plain_distances(spark):
    bad = ["scumbag", "pathetic", "vermin", "moron", "dolt", "dolts", "scummy"]
    rows = []
    for k in range(700):
        words = prose(40).split()
        for w in bad if k % 6 == 0 else (["moran"] if k % 9 == 0 else []):
            words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words), int(k % 6 == 0), "clash"))
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = toxicity.fit(own, own.select("doc_id", "toxic"))
    texts = [None, "", " ".join(w for w in bad for _ in range(20_000))]
    for _ in range(600):
        words = prose(rng.randint(1, 12)).split()
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(bad))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "4", "*", "z"])
            words.insert(rng.randrange(len(words) + 1), rng.choice(["{}", '"{}"', "said {}", "«{}»", "{}!", "no\n{}"]).format("".join(w)))
        texts.append(" ".join(words))
    some = spark.createDataFrame([(k % 50, t, "clash", k) for k, t in enumerate(texts)], "doc_id long, text string, score string, at long")
    got = {r.doc_id: r.score for r in toxicity.score(some, model, id_col="at").collect()}
    for k, t in enumerate(texts):
        if k != 2:
            assert abs(got[k] - brute_score(model, t)) < 1e-9, t
    assert got[2] > 0.99 and toxicity.score(some, model).count() == len(texts)  # repeated ids and a very long text


def test_repetition(docs, none):
    def brute(t):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]

        def cover(n):
            c = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            return {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}

        seen, again = set(), []
        for x in lines:
            if x in seen:
                again.append(x)
            seen.add(x)
        chars = sum(map(len, w))
        three = len(cover(3))
        failed = len(w) < 50 or 100 * three > 50 * len(w)
        fine = sum(len(y) for x in again for y in WORD.findall(x)) <= repetition.MOST_IN_LINES * chars and all(sum(len(w[j]) for j in cover(n)) <= m * chars for n, m in repetition.MOST_IN_GRAMS.items())
        return len(w), chars, len(again), three, failed, not failed and fine

    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in repetition.repetition(docs).collect())
    assert got == collections.Counter((k, *brute(t)) for k, t, *_ in DOCS)
    assert repetition.repetition(none).count() == 0


def test_hamming(spark):
    r = np.random.default_rng(3)
    codes = [int(x) for x in r.integers(-(2**63), 2**63, 300)] + [5] * 400 + [int(x) ^ 3 for x in r.integers(0, 50, 50)]
    rows = [*enumerate(codes), (9999, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {(x.query_id, x["rank"]): (x.neighbor_id, x.distance) for x in hamming.hamming_topk(df, df.where("id % 50 = 0"), 7).collect()}
    for q in range(0, len(codes), 50):
        best = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), k) for k, c in enumerate(codes))[:7]
        assert [got[q, n + 1] for n in range(7)] == [(k, d) for d, k in best]


def test_hamming_codes_and_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, -1.0, nan, None, 2.0]), (2, []), (3, None), (50, [1.0, 0.0, 0.0, 0.0, 2.0]), (50, [1.0, 0.0, 0.0, 0.0, 2.0]), (7, [0.0] * 64), (8, [1.0] * 64)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("rank", F.lit("clash"))
    coded = df.select("id", hamming.sign_code(F.col("v")).alias("code"), "rank")
    assert [r.code for r in coded.collect()] == [17, None, None, 17, 17, 0, -1]
    got = sorted(tuple(r) for r in hamming.hamming_topk(coded, coded.where("id = 50"), 3).collect())
    assert got == sorted([(50, 1, 1, 0), (50, 2, 50, 0), (50, 3, 50, 0)] * 2)  # the repeated row asks and answers twice
    assert hamming.hamming_topk(coded.where("false"), coded, 3).count() == 0 and hamming.hamming_topk(coded, coded.where("false"), 3).count() == 0
    with pytest.raises(Exception, match="64"):
        spark.createDataFrame([(1, [1.0] * 65)], "id long, v array<double>").select(hamming.sign_code(F.col("v"))).collect()
    assert [sum(b for _, b in hamming.segments_for(n)) for n in (0, 1, 2, 1000, 10**9, 10**18)] == [64] * 6


def test_hamming_looks_into_few_buckets_and_cuts_large_ones(spark, monkeypatch):
    """Rows sent grow as the queries: a query at its usual distance meets some hundred buckets, not all ways to flip log2(n) bits."""

    def sent(n, bound):
        cuts = hamming.segments_for(n)
        m, widest = len(cuts), max(b for _, b in cuts)
        return sum(min(m, max(0, bound - (m * r - 1))) * math.comb(widest, r) for r in range(widest + 1))

    # distances of the tenth of so many random codes, about
    assert sent(50_000, 18) <= sent(10_000, 19) <= 200 and sent(15_000_000, 13) <= 500
    r = np.random.default_rng(5)
    near = np.uint64(77) ^ (np.uint64(1) << r.integers(40, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << r.integers(40, 64, 150).astype(np.uint64))
    codes = np.concatenate([r.integers(0, 2**64, 60, dtype=np.uint64), near, near[:20]]).view(np.int64).tolist()
    monkeypatch.setattr(hamming, "PIECE", 7)
    df = spark.createDataFrame([*enumerate(codes)], "id long, code long")
    got = {(x.query_id, x["rank"]): (x.neighbor_id, x.distance) for x in hamming.hamming_topk(df, df.where("id % 30 = 0"), 12).collect()}
    for q in range(0, len(codes), 30):
        best = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), k) for k, c in enumerate(codes))[:12]
        assert [got[q, n + 1] for n in range(12)] == [(k, d) for d, k in best]


def test_main_text(spark):
    page = "<html><head><title>t</title><script>x='</p>'</script></head><body><nav>menu</nav><div class='cookie-notice'>accept</div>{}<div>site &amp; motto</div><footer>foot</footer></body>"
    rows = [(k, f"https://h.org/{k}", page.format(f"<div><p>Text {k} &lt;b&gt; a<b>b</b>c<p>more\n\n here<br>{k}</div>")) for k in range(12)]
    rows += [(98, None, None), (99, "https://o.org/", "<article><h1>T</h1><p>a&nbsp;b</p><form>f</form><ul><li>i<li>j</ul></article><p>out"), (99, "https://o.org/", "<p>broken <b")]
    got = {(r.page_id, r.text) for r in mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(k, f"Text {k} <b> abc more here {k}") for k in range(12)} | {(98, ""), (99, "T a b i j"), (99, "broken <b")}


def test_main_text_by_templates(spark):
    rng_ = random.Random(11)
    blocks = {h: [f"<div class=b{k}>{prose(3)}<p>{prose(2)}</p></div>" for k in range(6)] for h in ("a.org", "b.org")}
    shown = {k: [b for j, b in enumerate(blocks.get(("a.org", "b.org", "c.org")[k % 3], ())) if j < 3 or rng_.random() < 0.3] for k in range(60)}  # three on every page, three on some
    met = collections.Counter((k % 3, b) for k, own in shown.items() for b in own)
    rows, want = [], {}
    for k, own in shown.items():
        text = f"{prose(5)} {k}"
        if k % 4 == 0:
            html = f"<body>{''.join(own)}<article><p>{text}</p><p>told on every page</p></article></body>"
            want[k] = f"{text} told on every page"
        else:
            html = f"<body>{''.join(own)}<div><p>{text}</p></div></body>"
            want[k] = " ".join((" ".join(re.sub(r"<[^>]*>", " ", b) for b in own if met[k % 3, b] < 10) + f" {text}").split())
        rows.append((k, f"https://{('a.org', 'b.org', 'c.org')[k % 3]}/{k}", html, "clash"))
    assert min(met.values()) < 10 <= max(met.values())
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `text` string").withColumns({"host": F.lit(1), "template": F.lit(2)})
    assert {r.page_id: r.text for r in mainhtml.main_text(df).collect()} == want
    assert mainhtml.main_text(df.where("false")).count() == 0


def test_main_text_of_hostile_pages(spark):
    pages = ["<div>" * 100_000 + "deep" + "</div>" * 100_000, "<b>" * 50_000 + "x</p>" * 50_000, '<a "' * 250_000 + ">text", '<a href="x' * 100_000, "<a x='1\" y=\"2' >one</a><a x=\"<p>\">two</a>", "<!-- open", "<script>", "a < b <3", "<p>" * 100_000, "<a class='" + " class=" * 100_000, "text " * 200_000]
    began = time.time()
    got = [mainhtml.read_page(p, frozenset([1])) for p in pages]
    assert time.time() - began < 30
    assert got[0] == "deep" and got[1] == "x" * 50_000 and got[2] == "text" and got[4] == "onetwo" and got[5:8] == ["", "", "a < b <3"] and got[8] == "" and got[10] == pages[10].strip()
    rows = [(k, None, p) for k, p in enumerate(pages)]
    assert mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == len(pages)


def test_cross_entropy_difference(docs, none):
    got = collections.defaultdict(list)
    for r in lmscore.cross_entropy_difference(docs, F.col("source") == "s1").collect():
        got[r.doc_id].append(r.score)
    c, h, n, vocab = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], [0, 0], set()
    for _, t, _, source, *_ in DOCS:
        w = WORD.findall(t or "")
        vocab.update(w)
        for m in [0, 1] if source == "s1" else [1]:
            c[m].update(zip([None, *w], w))
            h[m].update([None, *w][:-1] if w else [])
            n[m] += len(w)
    a, b, v = lmscore.ADD, lmscore.ADD * n[1] / n[0], len(vocab)
    for k, t, *_ in DOCS:
        w = WORD.findall(t or "")
        want = sum(math.log((c[0][p] + a) / (h[0][p[0]] + a * v)) - math.log((c[1][p] + b) / (h[1][p[0]] + b * v)) for p in zip([None, *w], w)) / len(w) if w else None
        assert all(x == want if want is None else abs(x - want) < 1e-9 for x in got[k])
    assert lmscore.cross_entropy_difference(none, F.col("source") == "s1").count() == 0


def test_mixing(docs, none):
    own = mixing.sizes(docs)
    got = mixing.mix(own).collect()
    assert len(got) == len(DOCS) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total = sum(r.size for r in got)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6 or all(x[0].target == 2 * x[0].source_size for x in by.values())
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows) and sum(r.taken for r in rows) == math.floor(rows[0].target)
    assert sorted(map(repr, mixing.mix(own).collect())) == sorted(map(repr, got))
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(len(WORD.findall(r.text or "")) for r in mixed) == sum(r.taken for r in got)
    assert mixing.mix(mixing.sizes(none)).count() == 0


def test_mixing_of_odd_tables(spark):
    rows = [(1, "a b c d", "s", 99, "x"), (1, "a b c d", "s", 99, "x"), (None, "e f", None, 98, "y"), (2, None, "s", 97, "z"), (3, " ", "t", 96, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, taken string").withColumns({"row": F.lit(7), "_key": F.lit(8), "target": F.lit(9)})
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert {r.size for r in got} == {99, 98, 97, 96} and {(r.row, r._key, r.target) for r in got} == {(7, 8, 9)}
    taken = mixing.mix(mixing.sizes(df)).collect()
    assert sum(len((r.text or "").split()) for r in got) == sum(r.taken for r in taken) == 14  # 12.5 and 2.5 words, cut down
    empty = mixing.mix(mixing.sizes(df.where("doc_id > 1"))).collect()  # no words at all
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(df.where("false")).count() == 0


@functools.cache
def passages():
    return collections.Counter(tuple(w[i : i + 50]) for _, t, *_ in DOCS for w in [WORD.findall(t or "")] for i in range(len(w) - 49))


def passage_words(t):
    w = WORD.findall(t)
    return {j for i in range(len(w) - 49) if passages()[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)}


def without_passages(t):
    gone = t and passage_words(t)
    return cut_words(t, gone) if gone else t


def cut_words(t, gone):
    out, at, words = [], 0, list(WORD.finditer(t))
    for j, m in enumerate(words):
        if j in gone:
            out.append("" if j - 1 in gone else t[at : m.start()])
            at = m.end()
    return "".join(out) + t[at:]


@pytest.mark.parametrize("task", [substrings.TASK, 2])
def test_substrings(docs, none, monkeypatch, task):
    monkeypatch.setattr(substrings, "TASK", task)  # 2: nearly every anchor is split by longer ones
    raw = [(k, (t or "").encode()) for k, t, *_ in DOCS]
    seen = collections.Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = collections.Counter()
    for k, b in raw:
        mark = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                mark[p : p + 400] = b"\1" * 400
        left = bytes(x for x, y in zip(b, mark) if not y)
        runs = sum(1 for p in range(len(mark)) if mark[p] and (p == 0 or not mark[p - 1]))
        want[k, len(b), sum(mark), runs, hashlib.sha256(left).hexdigest(), len(passage_words(b.decode()))] += 1
    assert collections.Counter(map(tuple, substrings.removal_report(docs).collect())) == want
    assert substrings.cleaned(none).count() == 0 and substrings.cleaned(docs).columns == docs.columns
    want = collections.Counter((k, without_passages(t)) for k, t, *_ in DOCS)
    odd = docs.withColumns({"text_key": F.lit(1), "key": F.lit(2), "spans": F.lit(3), "row": F.lit(4), "a.b": F.lit(5)})
    got = substrings.cleaned(odd, substrings.PASSAGES).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    assert {(r.text_key, r.key, r.spans, r.row, r["a.b"]) for r in got} == {(1, 2, 3, 4, 5)} and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


@pytest.mark.parametrize("task", [substrings.TASK, 2])
@pytest.mark.parametrize("size", [400, 401, 700])
def test_substrings_from_inside_a_word(spark, monkeypatch, task, size):
    monkeypatch.setattr(substrings, "TASK", task)
    own = random.Random(size)
    text = lambda n: " ".join("".join(own.choice("abcdefgh") for _ in range(own.randint(2, 8))) for _ in range(n))
    two, many, whole = (("q" + text(400))[:size] for _ in range(3))
    rows = [(1, text(30) + " " + two + "#" + text(30)), (2, text(30) + "zz" + two + "%" + text(30))]  # a word start, and the only other inside a word
    rows += [(3, text(9) + " " + many + "#"), *((k, text(9) + "mnoprst"[k] + many + f"{k}%") for k in range(4, 7)), (7, whole + "#" + text(9)), (8, text(9) + "\u00fc" + whole)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = {1: two, 2: two, **dict.fromkeys(range(3, 7), many), 7: whole, 8: whole}
    assert got == {k: (size, 1, hashlib.sha256(t.replace(cut[k], "", 1).encode()).hexdigest()) for k, t in rows}


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("task,leaf,block,sets", [(neardup.TASK, neardup.LEAF, neardup.BLOCK, neardup.SETS), (6, 4, 3, 900), (6, 4, 1, 0)])
def test_near_duplicates(docs, none, monkeypatch, task, leaf, block, sets):
    monkeypatch.setattr(neardup, "TASK", task)  # small: nodes are linked in blocks and branch on the cluster
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SETS", sets)  # small: groups are confirmed leaf by leaf
    sets = [shingles(t) for _, t, *_ in DOCS]
    top = list(range(len(DOCS)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(DOCS)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                top[find(i)] = find(j)
    name = {}
    for i, (k, *_) in enumerate(DOCS):
        name[find(i)] = min(x for x in (name.get(find(i)), k) if x is not None) if k is not None or name.get(find(i)) is not None else None
    want = collections.Counter((k, len(sets[i]), name[find(i)] if sets[i] else k) for i, (k, *_) in enumerate(DOCS))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()) == want
    assert neardup.near_duplicates(none).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """Many texts, all different, near one base; some more share its least shingles only."""
    monkeypatch.setattr(neardup, "TASK", 70)
    monkeypatch.setattr(neardup, "BLOCK", 30)
    base = prose(150).split()
    texts = []
    for k in range(160):
        own = list(base)
        if k % 10 == 0:  # half another text
            own[:75] = prose(75).split()
        else:
            own[k % 150] = f"new{k}"
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                top[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {i: find(i) for i in range(len(texts))}


def test_one_row_of_each_component_stays(spark):
    base, other, third, nulls, alone, first, second = (prose(80) for _ in range(7))
    rows = [(1, base), (None, base + " x"), (None, alone), (None, ""), (None, None)]  # a null-id copy, a unique null-id text, no words
    rows += [(2, other), (3, other + " x"), (3, third)]  # an id on two texts, one of them a copy
    rows += [(4, first), (4, first), (5, first + " x"), (None, nulls), (None, nulls + " x"), (None, nulls)]  # repeated rows, a group of null ids
    rows += [(6, second), (7, second + " x"), (6, second + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fold = lambda t: t and re.sub(" [xy]$", "", t)
    want = collections.Counter({(1, base): 1, (None, alone): 1, (None, ""): 1, (None, None): 1, (2, other): 1, (3, third): 1, (4, first): 1, (None, nulls): 1, (6, second): 1})
    assert collections.Counter((r.doc_id, fold(r.text)) for r in neardup.without_duplicates(docs).collect()) == want
    assert neardup.near_duplicates(docs).where("kept").count() == len(want)


def test_url_rules(spark):
    urls = ["https://Example.com/en/x?q#f", "http://www.example.com/en/", "http://a.net/fr/b", "http://net/es/", "x://badcom/en/", "http://com", "no url", None, "http://a.org/?http://com/"]
    rows = [(k % 5, u) for k, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(urlrules.RULES, "verdict string, host string, path string")

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urlrules.RULES if f".{host}".endswith(f".{h}") and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    got = collections.Counter(map(tuple, urlrules.judge(pages, rules).collect()))
    assert got == collections.Counter((k, *brute(u)) for k, u in rows)
    assert urlrules.judge(pages, rules.where("false")).where("rule IS NOT NULL").count() == 0


def test_url_rules_over_ranges(spark):
    hosts = ["example.com", "www.example.com", "a.net", "b.net", "net", "x.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'es/', 'fr/', ''])}{rng.randint(0, 99)}" for _ in range(400)] + ["http://a.net/es/hot"] * 300 + [None] * 200 + ["http://a.org/" + "x" * 100_000]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id long, url string, host int").withColumns({"key": F.lit(1), "part": F.lit(2), "rule": F.lit(3)})
    rules = spark.createDataFrame(urlrules.RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(pages, rules).collect()}
    for k, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urlrules.RULES if f".{host}".endswith(f".{h}") and path.startswith(p)]
        assert got[k] == ((max(fits)[1], max(fits)[2]) if fits else (None, "allow"))
    assert len(got) == len(urls) and urlrules.judge(pages.where("false"), rules).count() == 0
    limits, first = urlrules.range_limits([("", "", 50), ("a", "x", 1), ("b", "y", 49)], 10)
    assert limits == [("", ""), ("b", "y")] and first == [0, 1, 6, 11]  # heavy pairs get a part for each range they fill
    assert urlrules.range_limits([], 4) == ([], [0, 1])


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage's rows against brute force on what the stage before it kept; null and repeated ids, repeated rows, odd columns."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "mixing", "packing"]
    toxic = [(k, prose(40) + " scumbag vermin " + prose(40), "en", "s1", 0, "toxic") for k in range(500, 620)]
    fine = [(k, prose(80), "en", "s2", 0, "fine") for k in range(700, 1000)]
    rows = DOCS + toxic + fine
    folder = str(tmp_path)
    labels = [(k, 0, 1) for k, *_ in toxic[:100]] + [(k, 0, 0) for k, *_ in fine]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    own = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(3), "text_key": F.lit(4), "row": F.lit(5)})
    own.write.parquet(f"{folder}/documents.parquet")
    at, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    plain = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())

    def step(name):
        nonlocal at
        stages[name](spark, at, folder).write.parquet(f"{folder}/{name}")
        before, at = at, spark.read.parquet(f"{folder}/{name}")
        return plain(before), plain(at)

    before, after = step("toxicity")
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert after == collections.Counter({x: n for x, n in before.items() if brute_score(model, x[1]) < 0.5})
    assert {k for k, _ in before - after} == {k for k, *_ in toxic}

    before, after = step("near_duplicates")
    texts = list(before.elements())
    sets = [shingles(t) for _, t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                top[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, x in enumerate(texts):
        groups[find(i) if sets[i] else -1 - i].append(x)
    assert sum(after.values()) == len(groups) and not after - before
    for own_ in groups.values():
        least = min((k for k, _ in own_ if k is not None), default=None)
        assert any(x in after and x[0] == least for x in own_)

    before, after = step("repeats")
    words = {x: WORD.findall(x[1] or "") for x in before}
    seen = collections.Counter(tuple(w[i : i + 50]) for x, n in before.items() for w in [words[x]] * n for i in range(len(w) - 49))
    want = collections.Counter()
    for (k, t), n in before.items():
        gone = {j for i in range(len(words[k, t]) - 49) if seen[tuple(words[k, t][i : i + 50])] > 1 for j in range(i, i + 50)}
        want[k, t if not gone else cut_words(t, gone)] += n
    assert after == want

    size = lambda t: len(WORD.findall(t or ""))
    taken = mixing.mix(mixing.sizes(at)).collect()
    before, after = step("mixing")
    assert sum(size(t) * n for (_, t), n in after.items()) == sum(r.taken for r in taken)
    assert all(any((t or "").startswith(x or "") or (x or "").startswith(t or "") for k2, x in before if k2 == k) for k, t in after)
    assert at.columns == own.columns and {(r.size, r.text_key, r.row) for r in at.collect()} == {(3, 4, 5)}

    packed = stages["packing"](spark, at, folder).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(k for (k, _), n in after.items() for _ in range(n))
    assert sorted(map(repr, ((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()))) == sorted(map(repr, ((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)))
