"""Main text of web pages by removal of site templates (operator 5).

Every page becomes an element tree. A hash of every subtree is counted per host over pages of different content; subtrees on
at least a fifth of a host's pages, and on ``LEAST_PAGES``, are its template and go. Copies of a page count once, and
paragraphs inside an article are never template, so a text that a host repeats is not lost. Elements that are boilerplate by
kind (menus, forms, scripts and the like, by tag, role or class) go too. At most five times the mean number of subtrees of a
page can recur on a fifth of a host's pages, so the list that each host carries is bounded.

Pages meet their host's list in a sort-merge join. A host that holds more than an even share of the bytes is dealt over as
many salts as shares it holds; parts grow in number with the bytes, and there are fewer such hosts than parts, so their
table is broadcast.

Defined results: null or empty html gives empty text; a null url, or one without host, counts as a host of its own name
""; repeated rows and null ids give a row each; broken markup is read as far as it goes, in time linear in its length,
and nesting may be of any depth; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, materialize, read, trimmed
from .urlrules import split_url

LEAST_PAGES, LEAST_SHARE = 10, 0.2
#: Pages that one part of the join reads.
BYTES_PER_PART = 1 << 26
QUOTE = "\"'"
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Up to the end of a tag or the next quoted value.
TO_VALUE = re.compile(r"[^>=]*(?:=(?!\s*[\"'])[^>=]*)*")
OPENS_VALUE = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GONE = frozenset("head script style noscript template nav footer aside form iframe svg button select textarea input label fieldset menu dialog canvas object audio video map title xmp noembed noframes".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Parts of class names and ids that stand for boilerplate, and those that only say where or what shape. A name counts if it has
#: one of the first kind and no part of another kind: "cookie-notice-bar" does, "notice-board" and "related-work" do not.
GONE_PARTS = re.compile(r"ads?|advert\w*|adsense|banner|breadcrumbs?|cookies?|consent|gdpr|notice|popup|modal|overlay|sidebar|menu|nav|navbar|navigation|footer|masthead|comments?|respond|disqus|replies|share|sharing|social|related|recommended|promo|newsletter|subscribe|sponsor\w*|widget")
PLACE_PARTS = re.compile(r"box|bar|block|wrap\w*|container|area|section|top|bottom|left|right|main|site|page|inner|outer|list|items?|links?|form|buttons?|icons?|panel|posts|articles|stories|signup|slot|unit|text|primary|secondary|global|js|\d*")
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption tr".split())
BLOCK = PARAGRAPH | frozenset("address article aside body details dialog div dl fieldset figure footer form header hgroup hr html main nav ol section summary table tbody thead tfoot ul br center".split())
#: Elements that may be template as a whole.
COUNTED = (BLOCK | {"nav", "aside", "menu", "fieldset"}) - {"html", "body", "article", "main", "br", "hr"}
SPACE = " "
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html", "figcaption"}
#: A start tag ends an open element of these kinds, up to the container named.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("table td th button object html body article section div".split())


class Element:
    __slots__ = ("children", "names", "role", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children = tag, []
        self.names, self.role = "", ""
        if "=" in attributes:
            for m in ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name in ("class", "id"):
                    self.names += f" {(m[2] or '').strip(QUOTE)}"
                elif name == "role":
                    self.role = (m[2] or "").strip(QUOTE).lower()


class Tags:
    """Tags of a page in order: (start, end, closes, name, attributes); comments and declarations have no name."""

    def __init__(self, html: str) -> None:
        self.html, self.quotes, self.closing = html, True, {}

    def close(self, quote: str, at: int) -> int:
        """The next such quote; once there is none, no later place looks again."""
        if self.closing.get(quote, 0) >= 0:
            self.closing[quote] = self.html.find(quote, at)
        return self.closing[quote]

    def end(self, at: int) -> int:
        """Just after the tag's ">" that no quoted value holds. After a tag that never ends so, quotes count no more."""
        html, start = self.html, at
        while self.quotes:
            at = TO_VALUE.match(html, at).end()
            if at >= len(html):
                self.quotes = False
            elif html[at] == ">":
                return at + 1
            else:
                m = OPENS_VALUE.match(html, at)
                close = self.close(m[1], m.end())
                at = close + 1 if close >= 0 else m.end()
        return html.find(">", start) + 1

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), False, None, ""
            if (m := NAME.match(html, start)) or html.startswith(("<!", "<?"), start):
                end = self.end(m.end()) if m else html.find(">", start) + 1
                if not end:
                    return None
                return start, end, bool(m) and html[start + 1] == "/", m[1].lower() if m else None, html[m.end() : end - 1] if m else ""
            at = start + 1
        return None


class Open:
    """The open elements, the root first, and where each tag stands among them."""

    def __init__(self, root: Element) -> None:
        self.stack, self.places, self.scopes = [root], {}, [0]

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(e)

    def last(self, tags) -> int:  # noqa: ANN001
        """Place of the innermost of these tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > at:
            e = self.stack.pop()
            self.places[e.tag].pop()
            if e.tag in SCOPE:
                self.scopes.pop()


def parse(html: str) -> Element:
    root = Element("html")
    tags, own, at = Tags(html), Open(root), 0
    while found := tags.after(at):
        start, end, closes, tag, attributes = found
        if start > at:
            own.stack[-1].children.append(html[at:start])
        at = end
        if tag is None:
            continue
        here = own.last((tag,))
        if closes:
            if here and (tag != "p" or here > own.scopes[-1]):
                own.cut(here)
            continue
        if tag in ("html", "body") and here:
            continue
        if tag in CLOSES_P and (p := own.last(("p",))) > own.scopes[-1]:
            own.cut(p)
        if tag in ENDS and (kind := own.last(ENDS[tag][0])) > own.last(ENDS[tag][1]):
            own.cut(kind)
        if tag == "body" and (head := own.last(("head",))):
            own.cut(head)
        element = Element(tag, attributes)
        own.stack[-1].children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if close:
                element.children.append(html[at : close.start()])
                at = html.find(">", close.start()) + 1 or len(html)
            else:
                at = len(html)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            own.push(element)
    if at < len(html):
        own.stack[-1].children.append(html[at:])
    return root


@lru_cache(10_000)
def named_gone(names: str, parts: re.Pattern = GONE_PARTS) -> bool:
    """Whether a class or id among ``names`` stands for boilerplate as a whole."""
    for name in names.lower().split():
        own = re.split(r"[-_]+", name)
        if any(parts.fullmatch(x) for x in own) and all(parts.fullmatch(x) or PLACE_PARTS.fullmatch(x) for x in own):
            return True
    return False


#: What an article may not be named.
COMMENT_PARTS = re.compile(r"comments?")


def boilerplate(e: Element, inside: bool) -> bool:
    if e.tag in GONE or (e.tag == "header" and not inside) or e.role in GONE_ROLES:
        return True
    if not e.names or e.tag in ("html", "body", "main"):
        return False
    return named_gone(e.names, COMMENT_PARTS) if e.tag == "article" else named_gone(e.names)


def content(root: Element, gone: set[int] | frozenset[int] = frozenset()) -> list[tuple[Element, bool]]:
    """The elements that hold the main text, and whether each is an article: the articles, else main, else all. ``gone``:
    ids of elements that are left out."""
    articles, mains, todo = [], [], [(root, False)]
    while todo:
        e, inside = todo.pop()
        if id(e) in gone or boilerplate(e, inside):
            continue
        if e.tag == "article":
            articles.append(e)
            continue
        if e.tag == "main":
            mains.append(e)
        todo.extend((c, inside or e.tag == "main") for c in reversed(e.children) if isinstance(c, Element))
    return [(e, True) for e in articles] or [(e, True) for e in mains[:1]] or [(root, False)]


def subtree_hashes(root: Element) -> tuple[bytes, dict[int, int]]:
    """Hash of the page by tags, names, text and children, and of each subtree that may be template (by the element's id)."""
    keys: dict[int, int] = {}
    own = lambda e: hashlib.blake2b(f"{e.tag}|{e.names}".encode("utf-8", "surrogatepass"), digest_size=8)
    path = [(root, False, iter(root.children), own(root))]
    while True:
        e, inside, rest, h = path[-1]
        for c in rest:
            if isinstance(c, Element):
                path.append((c, inside or e.tag in ("article", "main"), iter(c.children), own(c)))
                break
            if t := c.strip():
                h.update(b"\0" + t.encode("utf-8", "surrogatepass"))
        else:
            path.pop()
            digest = h.digest()
            if e.tag in COUNTED and not (inside and e.tag in PARAGRAPH):
                keys[id(e)] = int.from_bytes(digest, "little", signed=True)
            if not path:
                return digest, keys
            path[-1][3].update(digest)


def text_of(e: Element, inside: bool, gone: set[int]) -> list[str]:
    out: list[str] = []
    todo: list = [*reversed(e.children)]
    while todo:
        c = todo.pop()
        if isinstance(c, Element):
            if id(c) in gone or boilerplate(c, inside):
                continue
            if c.tag in BLOCK:
                out.append(" ")
                todo.append(SPACE)
            todo.extend(reversed(c.children))
        else:
            out.append(c if c is SPACE else unescape(c))
    return out


def read_page(html: str, template: frozenset[int]) -> str:
    root, gone = parse(html), set()
    if template:
        gone = {e for e, key in subtree_hashes(root)[1].items() if key in template}
    out: list[str] = []
    for e, inside in content(root, gone):
        out += [" ", *text_of(e, inside, gone)]
    return " ".join("".join(out).split())


def page_hashes(html: str) -> tuple[int, list[int]]:
    """A hash of the page and the hashes of its subtrees that may be template."""
    whole, keys = subtree_hashes(parse(html))
    return int.from_bytes(whole, "little", signed=True), sorted(set(keys.values()))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text, n_chars."""
    host, _ = split_url(F.col(url_col).cast("string"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), as_text(pages, html_col).alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [page_hashes(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["host", "page", "trees"])

    seen = materialize(own.select("host", "html").mapInArrow(trimmed(hashes), "host string, page bigint, trees array<bigint>").dropDuplicates(["host", "page"]))
    of_host = seen.groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.select("host", F.explode("trees").alias("tree")).groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    template = counts.join(of_host, "host").where(F.col("n") >= least_share * F.col("pages")).groupBy(F.col("host").alias("_host")).agg(F.collect_list("tree").alias("template"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [read_page(h, frozenset(t or ())) for h, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [own.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    size = materialize(own.groupBy("host").agg(F.sum(F.octet_length("html") + 1).alias("bytes")))
    total = size.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BYTES_PER_PART))
    share = max(1, total // parts)
    # fewer than ``parts`` hosts hold more than a share
    salts = size.where(F.col("bytes") > share).select(F.col("host").alias("_of"), F.ceil(F.col("bytes") / F.lit(share)).cast("bigint").alias("_salts"))
    salted = own.join(F.broadcast(salts), own["host"] == salts["_of"], "left").withColumn("_salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("_salts", F.lit(1))))
    lists = template.join(F.broadcast(salts), F.col("_host") == F.col("_of"), "left").withColumn("_to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1))).select("_host", "_to", "template")
    salted, lists = salted.repartition(parts, "host", "_salt"), lists.repartition(parts, "_host", "_to")
    joined = salted.join(lists.hint("merge"), (salted["host"] == lists["_host"]) & (salted["_salt"] == lists["_to"]), "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(trimmed(extract), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
