"""Toxicity from a learned lexicon, matched with Levenshtein automata over a trie (operator 2).

Fit: words whose neighbours vary, and word beginnings that many such words share, are taken into the lexicon where they
mark toxic rows (log-likelihood ratio and odds against clean rows). Counting distinct pairs of neighbours instead of rows
keeps copies of one toxic text from filling the lexicon. The lexicon is a trie; the union of its terms' Levenshtein
automata is walked as one lazily built deterministic automaton, so a word costs a table look-up a letter. Digits and signs
inside a word stay in it there. A second look at the fit rows weighs exact, misspelled and quoted hits apart; a misspelling
that clean or several toxic rows do not settle has a share of its term's weight, the larger the longer the term. Score: prior odds, plus the best hit of each term, in a
window that discounts quotation (quotation marks around, or a word of reporting near) and raises hits that come in groups.

Only labelled rows whose crc32(doc_id) mod 5 is not 0 are fitted, at most ``FIT_ROWS`` of them, chosen by hash; the
size of the lexicon follows from the tests on those rows alone. Labels, language, source and id never enter a score.

Defined results: null or empty text has no hits and gets the score of such rows; repeated rows and null ids give a row
each (a null id is held out: its remainder is unknown); with no usable labels the lexicon is empty and every score is 0;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, materialize, read, trimmed

FIT_ROWS = 12_000
LEAST_G2, LEAST_ODDS = 23.0, 10.0
#: Terms from this length on are met within one edit; those of one letter less only where the edit is a digit or sign.
SHORTEST_FUZZY = 5
#: Share of a hit's weight that is left inside quotation while too few quoted hits are known to learn it.
QUOTED, QUOTED_KNOWN = 0.1, 30
WINDOW = 80
CACHE_WORDS, CACHE_STATES, PLACES_AT_ONCE = 50_000, 20_000, 50_000
TERM = re.compile(r"[^\W\d_]+")
#: A word with the digits and signs inside it, as the automaton reads it.
WRITTEN = re.compile(r"[$@]?[^\W_]+(?:[*@$!|+.'’#%&~^=_-][^\W_]+)*")
QUOTES = (("\"", "\""), ("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’"))
REPORTING = frozenset("said says say called quote quoted wrote written word term insult slur phrase dijo llamó sagte nannte dit appelé".split())


class TermAutomaton:
    """Words within one edit of a term or of a stem's form, or that begin with a stem; deterministic states are made when
    first met. Edits of a state: 0, 1, or 2 for one edit by a digit or sign."""

    def __init__(self, terms: list[tuple[str, bool]], forms: list[tuple[str, int]] = ()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.fuzzy: set[int] = set()
        self.strict: set[int] = set()
        self.ends: dict[int, int] = {}
        for k, term, is_stem in [*((k, *t) for k, t in enumerate(terms)), *((k, form, False) for form, k in forms)]:
            node = 0
            fuzzy = not is_stem and len(term) >= SHORTEST_FUZZY
            strict = not is_stem and len(term) >= SHORTEST_FUZZY - 1
            for c in term:
                if fuzzy:
                    self.fuzzy.add(node)
                if strict:
                    self.strict.add(node)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            if fuzzy:
                self.fuzzy.add(node)
            if strict:
                self.strict.add(node)
            (self.stem if is_stem else self.word)[node] = k
            if not is_stem:
                self.ends[node] = len(term)
        self.forget()

    def forget(self) -> None:
        """Start over with no states made, so that a long task's states do not fill its memory."""
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int | None] = []
        self.first = self.state(frozenset(self.closed({(0, 0)})))

    def closed(self, own: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With letters of the term left out."""
        more = {(child, 1) for node, e in own if e == 0 for child in self.children[node].values() if child in self.fuzzy}
        own = own | more
        return {(n, e) for n, e in own if e == 0 or (n, 0) not in own}

    def state(self, own: frozenset) -> int:
        if own not in self.number:
            self.number[own] = len(self.sets)
            self.sets.append(own)
            self.next.append({})
            hits = [(min(e, 1), self.word[n]) for n, e in own if n in self.word and (e == 0 or self.ends[n] >= SHORTEST_FUZZY - (e == 2))]
            self.accepts.append(min(hits) if hits else None)
            self.stems.append(min((self.stem[n] for n, e in own if e == 0 and n in self.stem), default=None))
        return self.number[own]

    def step(self, at: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        edit, near = (1, self.fuzzy) if c.isalpha() else (2, self.strict)
        for node, e in self.sets[at]:
            child = self.children[node].get(c)
            if child is not None and (e == 0 or child in (self.strict if e == 2 else self.fuzzy)):
                out.add((child, e))
            if e == 0:
                if node in near:
                    out.add((node, edit))
                out.update((x, edit) for x in self.children[node].values() if x in near)
        self.next[at][c] = got = self.state(frozenset(self.closed(out))) if out else -1
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None."""
        at, stem, moves, stems = self.first, None, self.next, self.stems
        for c in word:
            to = moves[at].get(c)
            at = self.step(at, c) if to is None else to
            if at < 0:
                return None if stem is None else (0, stem)
            if stems[at] is not None:
                stem = stems[at]
        got = self.accepts[at]
        return got if stem is None or (got and got[0] == 0) else (0, stem)


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    plain: dict[int, float] = field(default_factory=dict)
    quoted: dict[int, float] = field(default_factory=dict)
    surfaces: dict[str, float] = field(default_factory=dict)
    forms: list[tuple[str, int]] = field(default_factory=list)
    prior: float = -30.0
    none: float = -30.0

    def misspelled(self, term: int, edits: int, surface: str) -> float:
        """Weight of a misspelling: its own where the fit rows settle it, else a share of the term's."""
        known = self.surfaces.get(surface)
        return self.plain[term] * (1 - 2 * edits / max(4, len(surface))) if known is None else known


def quoted(text: str, start: int, end: int) -> bool:
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before, after = before.rpartition("\n")[2], after.partition("\n")[0]
    for opening, closing in QUOTES:
        if opening == closing:
            if before.count(opening) % 2 and closing in after:
                return True
        elif before.rfind(opening) > before.rfind(closing) and closing in after:
            return True
    return not REPORTING.isdisjoint(TERM.findall(before)[-4:])


class Matcher:
    """Hits of a text: (term, edits, surface, quoted, neighbours within the window)."""

    def __init__(self, terms: list[tuple[str, bool]], forms: list[tuple[str, int]] = ()) -> None:
        self.automaton = TermAutomaton(terms, forms)
        self.known: dict[str, list[tuple[int, int, int, int]]] = {}

    def within(self, word: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, term) inside a written word: its exact parts, else the word as a whole, else misspelled parts."""
        whole = self.automaton.match(word)
        if word.isalpha():
            return [(0, len(word), *whole)] if whole else []
        parts = [(m.start(), m.end(), *got) for m in TERM.finditer(word) if (got := self.automaton.match(m[0]))]
        exact = [p for p in parts if p[2] == 0]
        return exact or ([(0, len(word), *whole)] if whole else parts)

    def hits(self, text: str) -> list[tuple[int, int, str, bool, int]]:
        text = text.lower()
        words = set(WRITTEN.findall(text))
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        if len(self.automaton.sets) > CACHE_STATES:
            self.automaton.forget()
        known = self.known
        for w in words.difference(known):
            known[w] = self.within(w)
        if not any(known[w] for w in words):
            return []
        places = [(m.start() + a, m.start() + b, e, t) for m in WRITTEN.finditer(text) for a, b, e, t in known[m[0]]]
        return [(t, e, text[a:b], quoted(text, a, b), sum(abs(c - a) <= WINDOW for c, *_ in places[max(0, k - 4) : k + 5]) - 1) for k, (a, b, e, t) in enumerate(places)]


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """text, toxic of the fit rows, one for each text."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").alias("_id"), as_text(docs, "text").alias("text"))
    joined = own.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("text", "toxic")  # chosen: at most ``most`` rows
    return materialize(joined.groupBy(F.md5("text").alias("k")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    rows = fit_rows(docs, labels, most)
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: set) -> pa.RecordBatch:
            cols = list(zip(*seen)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["word", "sides", "toxic"])

        for b in batches:
            seen: set = set()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = ["", *TERM.findall(text.lower()), ""]
                seen.update((w, f"{p} {q}", toxic) for p, w, q in zip(words, words[1:], words[2:]))
                if len(seen) > PLACES_AT_ONCE:
                    yield out(seen)
                    seen = set()
            yield out(seen)

    places_ = rows.select("text", F.col("toxic").cast("int")).mapInArrow(trimmed(places), "word string, sides string, toxic int").select("word", F.xxhash64("sides").alias("sides"), "toxic").distinct()
    counts = materialize(places_.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")))
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    all1, all0 = total["a"] or 1, total["b"] or 1
    both = F.col("a") + F.col("b")
    part = lambda k, n: F.when(k > 0, k * F.log(k / (both * (n / (all1 + all0))))).otherwise(0.0)
    tested = lambda df: df.withColumn("g2", 2 * (part(F.col("a"), all1) + part(F.col("b"), all0))).where((F.col("g2") >= LEAST_G2) & ((F.col("a") + 0.5) / (F.col("b") + 0.5) >= LEAST_ODDS * all1 / all0))
    starts = counts.where(F.length("word") >= 4).select(F.explode(F.transform(F.sequence(F.lit(4), F.least(F.length("word"), F.lit(7))), lambda k: F.substring("word", F.lit(1), k))).alias("word"), "a", "b")
    stems = tested(starts.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("n"), F.max("a").alias("most")).where("n >= 5 and 2 * most <= a"))
    top = lambda df: df.orderBy(F.desc("g2"), "word").collect()  # bounded by the words of the fit rows
    found_stems: list[str] = []
    weight = {r["word"]: r["a"] for r in top(stems)}
    for s in sorted(weight, key=lambda s: (len(s), s)):
        if not any(s.startswith(x) or x.startswith(s) for x in found_stems):
            # as long as nearly all toxic places stay
            while longer := [x for x in weight if len(x) == len(s) + 1 and x.startswith(s) and weight[x] >= 0.9 * weight[s]]:
                s = longer[0]
            found_stems.append(s)
    marked = [r["word"] for r in top(tested(counts))]
    words = [w for w in marked if not any(w.startswith(s) for s in found_stems)]
    terms = [(s, True) for s in found_stems] + [(w, False) for w in words]
    forms = [(w, k) for w in marked for k, (s, is_stem) in enumerate(terms) if is_stem and w.startswith(s)]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, forms)
        for b in batches:
            out = []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                got = matcher.hits(text)
                out += [(*h, toxic) for h in {(t, e, w if e else "", q) for t, e, w, q, _ in got}] or [(-1, 0, "", False, toxic)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32()))], ["term", "edits", "surface", "quoted", "toxic"])

    seen = rows.select("text", F.col("toxic").cast("int")).mapInArrow(trimmed(hits), "term int, edits int, surface string, quoted boolean, toxic int").groupBy("term", "edits", "surface", "quoted").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    # of misspellings only those that the rows settle are used
    seen = seen.where("edits = 0 OR b > 0 OR a > 2").orderBy("term", "edits", "surface", "quoted").collect()
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    model = Model(terms=terms, forms=forms, prior=math.log(n1 / n0))
    quoted_all = [0, 0]
    for r in seen:
        a, b = r["a"], r["b"]
        if r["term"] < 0:
            model.none = math.log((a + 0.5) / (b + 0.5))
        elif r["edits"]:
            model.surfaces[r["surface"]] = odds(a, b)
        elif r["quoted"]:
            quoted_all = [quoted_all[0] + a, quoted_all[1] + b]
        else:
            model.plain[r["term"]] = odds(a, b)
    for k in range(len(terms)):
        weight = model.plain.setdefault(k, odds(1, 0))
        model.quoted[k] = QUOTED * weight if sum(quoted_all) < QUOTED_KNOWN else min(weight, odds(*quoted_all))
    if model.none <= -30:
        model.none = model.prior
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_hits, best_hit (the surface that weighs most)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of FIT_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        matcher = Matcher(m.terms, m.forms)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                hits = matcher.hits(text)
                best: dict[int, tuple[float, str]] = {}
                for term, edits, surface, in_quotes, near in hits:
                    weight = m.misspelled(term, edits, surface) if edits else m.quoted[term] if in_quotes else m.plain[term]
                    if edits and in_quotes:
                        weight = min(weight, QUOTED * weight)
                    weight *= 1 + 0.1 * min(near, 3) if weight > 0 else 1
                    if term not in best or weight > best[term][0]:
                        best[term] = (weight, surface)
                logit = m.prior + sum(w for w, _ in best.values()) if best else m.none
                out.append((1 / (1 + math.exp(-max(-40.0, min(40.0, logit)))) if m.terms else 0.0, len(hits), max(best.values())[1] if best else None))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.string())))], ["doc_id", "score", "n_hits", "best_hit"])

    return docs.select(F.col(id_col).alias("doc_id"), as_text(docs, text_col).alias("text")).mapInArrow(trimmed(run), f"doc_id {kind}, score double, n_hits bigint, best_hit string")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more, in one pass over the texts."""
    got = score(docs.select("text", F.struct(*docs.columns).alias("_row")), fit(docs, labels), id_col="_row")
    return got.where("score < 0.5").select("doc_id.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
