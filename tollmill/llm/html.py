"""Operator 4: the main text of web pages by tree scoring.

A page is read into a tree of its block elements. Each paragraph gives points for its length and its commas to its parent,
half of them to the grandparent and less to further ancestors; an element's points are discounted by the share of its text
that stands in links. The best element is the article; siblings that score well beside it, or are plain paragraphs next to
it, belong to it too, also where the best element is an article. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out by element, role or the words of class and id, wherever they stand. A class
that only says what an element has, lacks or is filed under is no verdict, and no word but those for comments, adverts and
notices of consent drops an article or what holds most of a page's text.

Points go up the tree in one pass from the last element to the first, half of them at each level, and an element knows the
innermost open one of each tag, so the cost of a page follows its length however deep it is.

Each page is worked on alone, inside its task, so nothing is shuffled. Null and empty pages give an empty text; pages
without any paragraph give the text of their article or body. Pages are read whole at any length. Repeated rows give equal
results; of elements with equal scores the first is the best. Columns other than those kept are not looked at, and those kept
may have any names but ``text`` and ``n_chars``. Character references are
decoded, white space inside a block becomes one space, and blocks are joined in page order by one line feed.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.llm.common import chunks, table

# --- fixed values: element names of the HTML standard by their role, and words that name page furniture ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "html body head article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset(
    "head nav aside footer menu dialog button select option datalist label template svg canvas math object audio video map "
    "script style textarea title xmp iframe noembed noframes noscript".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense adbox sponsor sponsored sponsors promo promoted promotion banner "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs pager pagination sidebar rail aside widget widgets "
    "header masthead topbar footer foot colophon copyright cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments commentlist disqus respond replies discussion related recommended recommendations share sharing social "
    "subscribe subscription newsletter signup login search searchbox form toolbar skip hidden".split()
)
#: Words that hold for whatever they are said of.
FIRM = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense adbox sponsor sponsored sponsors cookie cookies consent gdpr popup modal "
    "comment comments commentlist disqus respond replies skip hidden".split()
)
#: Beside these, a word says what an element has, lacks or is about.
QUALIFIERS = frozenset("has have no not without with is in category categories tag tagged tags type format topic section status".split())
#: A header of one of these holds a headline.
STORIES = frozenset("entry article post story content page".split())
#: What a start tag of the key ends, if it is open inside the same block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an element to end stops.
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# --- end of fixed values ---

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

SHORTEST = 25  # a shorter paragraph gives no points
SHARE = 0.2  # of the best score, for siblings
ARTICLES = ("article", "main")


class Element:
    """An element: ``block`` is the innermost block it lies in (itself, if it is one), ``doubt`` a word against it."""

    __slots__ = ("tag", "parent", "block", "depth", "out", "doubt", "header", "score", "chars", "linked", "index", "kept")

    def __init__(self, tag: str, parent: Element | None, out: bool, index: int):
        self.tag, self.parent, self.out, self.index = tag, parent, out, index
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.depth = parent.depth + 1 if parent else 0
        self.doubt, self.header, self.kept = "", parent.header if parent else False, False
        self.score, self.chars, self.linked = 0.0, 0, 0


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def _verdict(tag: str, raw: str) -> str:
    """What the attributes say of an element: "out", a word of doubt, "header" for the header of a story, or nothing."""
    if "=" not in raw and "hidden" not in raw:
        return ""
    found = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return "out"
    if found.get("role") in LEFT_OUT_ROLES:
        return "out"
    if tag in ("html", "body", "main"):
        return ""
    doubt = ""
    for name in html.unescape(found.get("class", "") + " " + found.get("id", "")).split():
        words = _WORD.findall(name)
        said = FURNITURE.intersection(words)
        if not said or not QUALIFIERS.isdisjoint(words):
            continue
        if said & FIRM:
            return "firm"
        if said == {"header"} and not STORIES.isdisjoint(words):
            doubt = doubt or "header"
        elif tag != "article":
            doubt = "soft"
    return doubt


def _read(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of text of a page, in order, and its elements."""
    root = Element("", None, False, 0)
    elements, stack, blocks = [root], [root], []
    opened: dict[str, list[int]] = {}  # depths of the open elements by tag
    text: list[str] = []
    linked = 0  # characters in links of the open block
    at, size = 0, len(page)

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append(Block(stack[-1].block, joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if opened.get("a"):
                linked += len(plain.strip())

    def innermost(tag: str) -> int:
        places = opened.get(tag)
        return places[-1] if places else 0

    def close(depth: int):
        for e in stack[depth:]:
            opened[e.tag].pop()
        del stack[depth:]

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            if not stack[-1].out:
                say(page[at:])
            break
        if not stack[-1].out:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            depth = innermost(tag)
            # the end of something inside a block does not reach beyond it
            if depth and (tag in BLOCK or depth > stack[-1].block.depth):
                close(depth)
            continue
        if tag == "br":
            if not stack[-1].out:
                text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            around = stack[-1].block
            if around.depth and (around.tag == "p" or (tag in HEADINGS and around.tag in HEADINGS)):
                close(around.depth)
            if tag in ENDS:
                fence = max((innermost(f) for f in FENCES.get(tag, ())), default=0)
                while (depth := max(innermost(e) for e in ENDS[tag])) > fence:
                    close(depth)
                    if tag != "tr":
                        break
        if tag in VOID:
            continue
        above = stack[-1]
        said = "" if above.out else _verdict(tag, m[3])
        element = Element(tag, above, above.out or tag in LEFT_OUT or said == "out", len(elements))
        if tag == "header" and not element.out:  # the header of an article holds its headline; other headers belong to the site
            element.out = not any(opened.get(t) for t in ARTICLES)
            element.header = True
        elif said == "header":
            element.header = True
        elif said != "out":
            element.doubt = said
        elements.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if m[3].endswith("/") and tag not in BLOCK and tag != "a":
            continue
        if tag == "a" and innermost("a") > above.block.depth:  # links do not nest
            close(innermost("a"))
            element.parent, element.block, element.depth = stack[-1], stack[-1].block, stack[-1].depth + 1
        stack.append(element)
        opened.setdefault(tag, []).append(len(stack) - 1)
    flush()
    return blocks, elements


def _density(e: Element) -> float:
    return e.linked / e.chars if e.chars else 0.0


def _sum_up(blocks: list[Block], elements: list[Element]) -> int:
    """Sets the characters of all elements, and in links; returns those of the page."""
    for e in elements:
        e.chars = e.linked = 0
    for b in blocks:
        b.element.chars += len(b.text)
        b.element.linked += b.linked
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.linked += e.linked
    return elements[0].chars


def main_text(page: str | None) -> str:
    """The article of one page, one block a line; empty if there is none."""
    if not page:
        return ""
    blocks, elements = _read(page)
    total = _sum_up(blocks, elements)
    for e in elements:  # parents come before their children
        if e.parent is not None and e.parent.out:
            e.out = True
        elif e.doubt == "firm" or (e.doubt or e.tag == "form") and 2 * e.chars < total:
            # a word, or a form, is passed over where it wraps most of the page
            e.out = True
    # inside a header, only headlines belong to the article
    blocks = [b for b in blocks if not b.element.out and (b.element.tag in HEADINGS or not b.element.header)]
    if not blocks:
        return ""

    _sum_up(blocks, elements)
    for b in blocks:
        e = b.element
        if e.tag in HEADINGS or len(b.text) < SHORTEST:
            continue
        holder = e.parent if e.tag in ("p", "pre", "li", "td", "dd", "blockquote") and e.parent is not None else e
        holder.score += 1 + b.text.count(",") + b.text.count("，") + min(len(b.text) / 100, 3)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.score += e.score / 2
    for e in elements:
        e.score *= 1 - _density(e)
    best = max(elements, key=lambda e: (e.score, -e.index))
    if best.score <= 0:
        best = next((e for e in elements if e.tag in ARTICLES and e.chars and not e.out), elements[0])
    holders = []
    at: Element | None = best
    while at is not None:
        holders.append(at)
        at = at.parent
    chosen = next((e for t in ("article", "main") for e in holders if e.tag == t), best)
    chosen.kept = True
    for e in elements if chosen.parent is not None and chosen.tag != "main" else ():
        if e.parent is not chosen.parent or e is chosen or e.out or not e.chars:
            continue
        plain = e.tag in ("p", chosen.tag) and (_density(e) < 0.25 if e.chars > 80 else _density(e) == 0)
        headline = (e.tag in HEADINGS or e.header) and e.index < chosen.index and _density(e) < 0.25
        e.kept = e.score > 0 and e.score >= chosen.score * SHARE or plain or headline
    for e in elements:
        e.kept = e.kept or e.parent is not None and e.parent.kept
    return "\n".join(b.text for b in blocks if b.element.kept)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of each page, its main text and the number of its code points."""
    names = [f"k{i}" for i in range(len(keep))]
    source = pages.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.col(html_col).alias("text"))
    kinds = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)

    def work(batches):
        for part in chunks(batches):
            texts = [main_text(p) for p in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*names, "text", "n_chars"],
            )

    done = source.mapInArrow(work, f"{kinds}, text string, n_chars long")
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "text", "n_chars")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
