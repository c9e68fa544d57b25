"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block tags.  What stands in menus, forms, scripts and the like, or in an element whose class or
id names a menu, sidebar, notice, advert, comment and so on, is left out at once; a main element is never left out with what is around it.  The first pass labels each block by
stop-word density, length and link density; inside an article or main element more links are allowed, and a long block without
stop words is ambiguous and not decided.  The second pass gives each ambiguous block the label of its nearest decided neighbour;
where the two sides are equally near and differ, it is text only if the one before is.  Blocks inside and outside of articles
are no neighbours of each other.  Without any decided neighbour a block is text if it is inside an article.

Defined results: null or empty html, or a page without text, gives the empty string; unclosed and stray tags are accepted as browsers
do; an unclosed comment or script runs to the end; repeated rows are each extracted; pages of any length are read whole.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.runtime import tune

# Tag names by their role.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
OUT_TAGS = frozenset("aside button canvas dialog footer form head iframe map menu nav noembed noframes noscript object script select style svg template textarea title xmp".split())
TEXT_TAGS = frozenset(("article", "main"))
# Parts of class and id names that mark boilerplate.
OUT_NAMES = frozenset("ad ads adv advert advertisement adverts advertising alert author-bio banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager paywall popup promo promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget".split())
#: The page header is out; these names do not count inside an article, where they hold the headline.
_HEADLINE = frozenset(("header", "masthead", "byline"))
#: A name with such a part says what the page has and is no such part itself, as in has-sidebar or page-with-menu.
_FRAME = frozenset("has layout no not with without".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
STOP_WORDS = frozenset("a an and are as at be by for from has have he in is it not of on or that the this to was were which with you der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an la le les et un une du que est pour qui dans par sur pas au avec el y los las del se por con no su al lo".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[a-zA-Z/][^>]*\Z", re.S)
_NAMES = re.compile(r"""(?:\A|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:\A|\s)hidden(?:\s|=|\Z)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

LONG, SHORT = 120, 40
STOP_HIGH, STOP_LOW, LINKS_HIGH, LINKS_INSIDE = 0.20, 0.08, 0.40, 0.80


@dataclass
class Block:
    text: str
    link_chars: int
    inside: bool  # in an article or main element
    label: str = ""
    decided: int = 1  # the pass that gave the label


def _out_names(attrs: str, inside: bool) -> bool:
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if _FRAME.isdisjoint(parts) and any(p in OUT_NAMES and not (inside and p in _HEADLINE) for p in (name.lower(), *parts)):
                return True
    return False


# What a start tag ends besides an open paragraph, and the elements that this does not reach out of.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = ("ul", "ol", "dl", "table", "select")


class Open:
    """The open elements.  The places of each tag are kept, so nothing is searched for and nesting of any depth costs the same."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # tag, left out, in an article
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # places of block elements but for paragraphs

    def last(self, *tags: str) -> int:
        return max(self.places[t][-1] if self.places.get(t) else -1 for t in tags)

    def push(self, tag: str, out: bool, inside: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS and tag != "p":
            self.solid.append(len(self.stack))
        self.stack.append((tag, out, inside))

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if self.solid and self.solid[-1] == len(self.stack):
                self.solid.pop()

    def close(self, tag: str) -> None:
        """An end tag closes the nearest element of its name; a stray one, or one of an inline element outside the block, does nothing."""
        k = self.last(tag)
        if k >= 0 and (tag in BLOCK_TAGS or k > max(self.solid[-1] if self.solid else -1, self.last("p"))):
            self.cut(k)

    def make_room(self, tag: str) -> None:
        """Opening a block ends an open paragraph; an item, cell or row ends the one before."""
        ends = _ENDS.get(tag, ())
        while True:
            k = self.last("p", *ends)
            stop = self.last(*_SCOPE)
            if not ends and self.solid:
                stop = max(stop, self.solid[-1])
            if k < 0 or k < stop:
                return
            was = self.stack[k][0]
            self.cut(k)
            if was != "p":
                return

    @property
    def out(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    @property
    def inside(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without those that stand in left-out elements."""
    blocks: list[Block] = []
    open_ = Open()
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append(Block(text, min(links, len(text)), open_.inside))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not open_.out:
            text = htmllib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if open_.places.get("a"):
                links += len(text.strip())

    at, find = 0, _TOKEN.search
    while m := find(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            add(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
        if m[1]:
            open_.close(name)
            continue
        if name in BLOCK_TAGS:
            open_.make_room(name)
        out, inside = open_.out and name != "main", open_.inside or name in TEXT_TAGS
        attrs = m[3] or ""
        if not out:
            out = name in OUT_TAGS or (name == "header" and not inside) or (bool(attrs) and name not in ("html", "body") and (_out_names(attrs, inside) or bool(_HIDDEN.search(attrs))))
        if name in RAW_TAGS:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in VOID_TAGS:  # a slash at the end of a start tag means nothing in HTML
            open_.push(name, out, inside)
    add(page[at:])
    flush()
    return blocks


def label(blocks: list[Block]) -> list[Block]:
    """Both passes: label is 'text' or 'other' afterwards."""
    for b in blocks:
        words = b.text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))
        density = b.link_chars / max(1, len(b.text))
        if density > (LINKS_INSIDE if b.inside else LINKS_HIGH):
            b.label = "other"
        elif len(b.text) >= LONG:
            b.label = "text" if stops >= STOP_LOW else "short" if b.inside else "other"
        elif len(b.text) >= SHORT and stops >= STOP_HIGH:
            b.label = "text"
        else:
            b.label = "short"
    for inside in (True, False):
        _inherit([b for b in blocks if b.inside == inside], "text" if inside else "other")
    return blocks


def _inherit(blocks: list[Block], alone: str) -> None:
    """The second pass; alone is the label of a block without decided neighbours."""
    fixed = [b.label for b in blocks]
    before, seen = [None] * len(blocks), None
    for k, name in enumerate(fixed):
        before[k] = seen
        seen = k if name != "short" else seen
    seen = None
    for k in range(len(blocks) - 1, -1, -1):
        if fixed[k] == "short":
            blocks[k].decided = 2
            p, n = before[k], seen
            if p is None and n is None:
                blocks[k].label = alone
            elif n is None or (p is not None and k - p <= n - k):
                blocks[k].label = fixed[p]
            else:
                blocks[k].label = fixed[n]
        else:
            seen = k


def main_text(page: str | None) -> str:
    """The blocks labelled text, joined by two line feeds."""
    return "\n\n".join(b.text for b in label(blocks_of(page or "")) if b.label == "text")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    tune(pages.sparkSession)
    given = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
