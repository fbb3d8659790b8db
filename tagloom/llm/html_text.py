"""Main text of web pages: site template removal by subtree hashes, then block text.

1. Every page is parsed into an element tree once. Its main element is the longest article, or the longest main
   element where that has more than twice its text, else the whole page. Menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles and comments that their tag, role or class names as such are left out.
   The rest is cut into blocks; white space in a block becomes one space.
2. An element's hash covers its tag and its text with all that is below it. The hashes of the block elements in
   the main element are counted per host in Spark, over the different main contents of the host's pages, so
   that copies of one page count once: what recurs under many different contents is template.
3. Subtrees whose hash recurs on at least ``min_pages`` different contents of their host, and on
   ``min_share`` percent of them or more, lose their blocks. Where a page marks its article or main element and more
   than half of its text would go so, the text itself recurs and not a template, and it stays. Elements of less
   than ``MIN_TEXT`` characters inside a marked one are not looked at, as short lines recur by chance.
4. Blocks are joined by an empty line.

Parsing is lenient: unclosed elements end with their parents, a new paragraph ends an
open one; trees may be of any depth. The counting is a grouped sum, so a host with a third of all pages is
summed in every task first; pages get the recurring hashes of their own back by a join on
(host, hash), never a host's whole list. Html is never shuffled: texts and hashes with block numbers are stored, and
the texts are shuffled only where the pages' recurring hashes are too many to be broadcast.

Edge cases: a null html or one without text gives an empty text. A null or odd url has the empty
host. Every row comes back, repeated rows and null ids too. Of main elements of equal length the first one
counts. A very long page is read whole, in one piece. Empty tables give empty results. Columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick

MIN_PAGES = 5
MIN_SHARE = 20
MIN_TEXT = 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>?", re.S
)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# furniture by tag, by role, and by the words of class and id
_FURNITURE = frozenset(
    "aside audio button canvas dialog embed fieldset footer form head header iframe input link menu meta nav noscript object option "
    "script select style svg template textarea title video".split()
)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner menu menus nav navbar "
    "navigation breadcrumb breadcrumbs sidebar header masthead footer cookie cookies consent notice notices gdpr popup modal newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply "
    "replies respond widget widgets toolbar skip pagination pager".split()
)
# words that may stand beside one of these in a name: site-header, ad-slot, comment-list; side-effects has another and says nothing
_BESIDE = frozenset(
    "site page main top bottom left right box block bar slot container wrapper wrap area list item items section content inner outer "
    "holder unit post posts article articles link links button buttons panel global primary secondary form text reader user".split()
)
_OWN_HEADER = frozenset(("header", "masthead"))
# inside an article only elements that hold others are judged by their names
_HOLDERS = frozenset("aside article details div dl form nav ol section table ul".split())
_NO_ARTICLE = frozenset("ad ads advert comment comments promo related reply replies sponsored teaser".split())
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
# an open element that a new one of these closes
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_SCOPE = frozenset("ul ol dl table tbody thead tfoot article section main div nav aside footer header form body blockquote td th".split())


def named_furniture(value: str, words: frozenset[str] = _WORDS) -> bool:
    """Whether one of the names in a class or id says furniture, with all of its words."""
    for name in value.lower().split():
        parts = [p for p in re.split("[-_]+", name) if p]
        if any(p in words for p in parts) and all(p in words or p in _BESIDE for p in parts):
            return True
    return False


class Element:
    """An element with its items (texts and elements), and what lies below it."""

    __slots__ = ("tag", "items", "furniture", "article", "content", "hidden", "hash", "size")

    def __init__(self, tag: str, parent: Element | None = None, attributes: str = ""):
        self.tag = tag
        self.items: list = []
        self.hash = self.size = 0
        inside = parent is not None and parent.article
        self.content = tag in ("article", "main")
        self.article = inside or tag == "article"
        self.furniture = tag in _FURNITURE and not (inside and tag == "header")
        if attributes and ("=" in attributes or "hidden" in attributes):
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                if key == "hidden" or (key == "aria-hidden" and value == "true"):
                    self.furniture = True
                elif key == "role":
                    role = value.strip().lower()
                    self.furniture |= role in _ROLES
                    self.content |= role in ("main", "article")
                    self.article |= role == "article"
                elif key in ("class", "id"):
                    if tag == "article":
                        self.furniture |= named_furniture(value, _NO_ARTICLE)
                    elif inside:
                        self.furniture |= tag in _HOLDERS and named_furniture(value, _WORDS - _OWN_HEADER)
                    elif tag not in ("html", "body", "main"):
                        self.furniture |= named_furniture(value)
        # in furniture, or furniture itself
        self.hidden = self.furniture or parent is not None and parent.hidden


class _Open:
    """The open elements; where the last one of a kind lies is known without a search."""

    def __init__(self, root: Element):
        self.elements = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    @staticmethod
    def _kinds(e: Element) -> Iterator[str]:
        yield e.tag
        if e.tag in _SCOPE:
            yield "(scope)"
            if e.tag not in ("td", "th"):
                yield "(scope of cells)"
        if e.tag in _BLOCK:
            yield "(block)"
        if e.content:
            yield "(content)"

    def last(self, kind: str) -> int:
        """Place of the last open element of a kind, 0 if there is none (the root counts as none)."""
        found = self.places.get(kind)
        return found[-1] if found else 0

    def push(self, e: Element) -> None:
        for kind in self._kinds(e):
            self.places[kind].append(len(self.elements))
        self.elements.append(e)

    def close(self, place: int) -> None:
        while len(self.elements) > place:
            for kind in self._kinds(self.elements.pop()):
                self.places[kind].pop()


def parse(source: str) -> list[Element]:
    """The elements of a page in their order, the root first; text items are decoded strings."""
    root = Element("html")
    every = [root]
    opened = _Open(root)
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        top = opened.elements[-1]
        if m is None:
            top.items.append(htmllib.unescape(source[at:]))
            break
        if m.start() > at:
            top.items.append(htmllib.unescape(source[at : m.start()]))
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            # an inline end tag does not reach out of its block, nor a block's out of an article
            barrier = opened.last("(content)") if tag not in ("body", "html", "main", "article") else 0
            if tag not in _BLOCK:
                barrier = max(barrier, opened.last("(block)"))
            place = opened.last(tag)
            if place and place >= barrier:
                opened.close(place)
            continue
        if tag in _BLOCK:
            # a block ends an open paragraph, with what is open in it
            place = opened.last("p")
            if place > opened.last("(scope)"):
                opened.close(place)
            for closed in _CLOSES.get(tag, ()):
                place = opened.last(closed)
                if place > opened.last("(scope of cells)"):
                    opened.close(place)
        if tag in ("html", "body"):
            continue
        element = Element(tag, opened.elements[-1], m.group(3) or "")
        opened.elements[-1].items.append(element)
        every.append(element)
        if tag in _VOID or (m.group(3) or "").endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            end = _RAW[tag].search(source, at)
            element.items.append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        opened.push(element)
    return every


def measure(every: list[Element]) -> None:
    """Set hash (order, tags and normalised text count) and size (characters outside furniture) of every element."""
    for element in reversed(every):
        h = xxhash.xxh64(element.tag)
        size = 0
        for item in element.items:
            if isinstance(item, str):
                h.update(" ".join(item.split()))
                size += len(item)
            else:
                h.update(item.hash.to_bytes(8, "little"))
                size += item.size
        element.hash = h.intdigest() & 0x7FFFFFFFFFFFFFFF
        element.size = 0 if element.furniture else size


def main_element(every: list[Element]) -> Element:
    """The longest article outside furniture, or the longest main element with more than twice its text, else the page."""
    best = {True: None, False: None}
    for e in every:
        if e.content and not e.hidden and e.size:
            is_article = e.tag != "main"
            if best[is_article] is None or e.size > best[is_article].size:
                best[is_article] = e
    article, main = best[True], best[False]
    if article and main and 2 * article.size < main.size:
        return main
    return article or main or every[0]


def blocks(main: Element) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Texts of the main element's blocks without furniture; hash, first and last block (exclusive) of the block elements in it."""
    texts: list[str] = []
    spans: list[tuple[int, int, int]] = []
    pieces: list[str] = []

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            texts.append(text)

    todo = [(main, iter(main.items), 0)]
    while todo:
        element, items, first = todo[-1]
        for i in items:
            if isinstance(i, str):
                pieces.append(i)
            elif i.tag == "br":
                pieces.append(" ")
            elif i.tag in _BLOCK:
                flush()
                if not i.furniture:
                    todo.append((i, iter(i.items), len(texts)))
                    break
            elif not i.furniture:
                todo.append((i, iter(i.items), -1))
                break
        else:
            todo.pop()
            if element.tag in _BLOCK or element is main:
                flush()
                if element is not main and len(texts) > first:
                    spans.append((element.hash, first, len(texts)))
    return texts, spans


_READ = "page_id bigint, url string, k bigint, host bigint, content bigint, marked boolean, text string, hashes array<bigint>, firsts array<int>, lasts array<int>"


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of every page, with the hashes and block numbers of the subtrees in it."""
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for source in batch.column(4):
            every = parse(source.as_py() or "")
            measure(every)
            main = main_element(every)
            texts, spans = blocks(main)
            marked = main is not every[0]
            spans = [s for s in spans if not marked or sum(map(len, texts[s[1] : s[2]])) >= MIN_TEXT]
            row = (main.hash, marked, "\n\n".join(texts), *([s[i] for s in spans] for i in range(3)))
            for c, x in zip(columns, row, strict=True):
                c.append(x)
        types = (pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            names=[c.split()[0] for c in _READ.split(", ")],
        )


def without(text: str, marked: bool, gone: frozenset[int], spans: list[tuple[int, int, int]]) -> str:
    """The text without the blocks of the subtrees that are gone; as it is if it would lose most of a marked article."""
    texts = text.split("\n\n")
    stay = [True] * len(texts)
    for h, first, last in spans:
        if h in gone:
            stay[first:last] = [False] * (last - first)
    kept = [t for t, s in zip(texts, stay, strict=True) if s]
    return text if marked and 2 * sum(map(len, kept)) < sum(map(len, texts)) else "\n\n".join(kept)


def _without_templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, marked, gone, *spans in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
            texts.append(text if gone is None else without(text, marked, frozenset(gone), list(zip(*spans, strict=True))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: int = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    ws = Workspace(pages.sparkSession, "html")
    types = {"page_id": "bigint"}
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    rows = pick(pages, "page_id", "url", "html", types=types)
    rows = rows.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("k"), host.alias("host"), "html")
    read = ws.keep(rows.mapInArrow(_read_pages, _READ), "read")
    # copies of a page have one content; sums per (host, hash) go through partial aggregation
    different = read.groupBy("host", "content").agg(F.first("hashes").alias("hashes"))
    contents = different.groupBy("host").agg(F.count(F.lit(1)).alias("contents"))
    recurring = (
        different.select("host", F.explode(F.array_distinct("hashes")).alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
        .join(contents, "host")
        .where(F.col("n") * 100 >= F.col("contents") * min_share)
        .select("host", "hash")
    )
    gone = (
        read.select("k", "host", F.explode("hashes").alias("hash"))
        .join(ws.keep(recurring, "recurring"), ["host", "hash"])
        .groupBy("k")
        .agg(F.collect_set("hash").alias("gone"))
    )
    # written first, so that its size is known: texts are only shuffled where it can't be sent to them
    text = (
        read.join(ws.keep(gone, "gone"), "k", "left")
        .select("page_id", "url", "text", "marked", "gone", "hashes", "firsts", "lasts")
        .mapInArrow(_without_templates, "page_id bigint, url string, text string")
    )
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
