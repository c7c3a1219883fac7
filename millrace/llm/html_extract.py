"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. Structure decides some at once: menus, page headers, footers,
sidebars, forms, adverts, notices, reader comments and hidden parts are boilerplate. The first pass judges the rest
by length, link density and stop-word density; short blocks stay open. In the second pass an open block takes the
label of the nearest decided blocks around it. Where a page marks its article, only that is searched, and there
a block needs no stop words: text may be in any language, or a table, or code.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.words import rows_of

SHORT = 70  # characters; shorter blocks take their neighbours' label
LONG = 200
LINKS = 0.5  # share of a block's characters within links that makes it boilerplate
STOP_LOW, STOP_HIGH = 0.2, 0.3

# fixed values: elements by their role in HTML, names that sites give to boilerplate, frequent words of four languages
_RAW = "script style title textarea iframe noembed noframes noscript template svg math xmp object canvas audio video select".split()
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_BOILERPLATE_TAGS = set("nav footer aside form menu dialog button head".split())
_BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
_BOILERPLATE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay paywall sidebar aside widget widgets menu menus nav navbar navigation navi breadcrumb "
    "breadcrumbs masthead topbar footer footnav comment comments disqus replies respond social share sharing related recommended "
    "recommendations newsletter subscribe subscription signup login search pagination pager hidden skip".split()
)
_HEADER_NAMES = {"header"}
_LAYOUT_NAMES = set("has no with without".split())  # "has-sidebar" is not the sidebar
_ARTICLE_BOILERPLATE = set("ad ads advert comment comments sponsored promo related recommended".split())
_ARTICLE_NAMES = set(
    "article post entry content main story maincontent main-content article-body article-content post-body post-content "
    "entry-content story-body".split()
)
_STOP_WORDS = set(
    "the of and to in a is that it for on as with was be by are this at from or an have not but they his her which you were all their "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et en un une que est pour qui dans ce il au sur pas plus par je avec se sont ne "
    "el los las y del que en un una por con no su para es se al lo como más o pero sus este ha".split()
)  # end of fixed values

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<raw>" + "|".join(_RAW) + r")(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")  # words of a name, at signs and capitals
_STRIP = re.compile(r"^\W+|\W+$")


class Block(NamedTuple):
    text: str
    linked: int  # characters within links
    outside: bool  # boilerplate by structure
    article: int  # number of the article it is in, 0 for none
    heading: bool


def _names(*values: str) -> set[str]:
    """Words of the names in class and id; what a name says that an element has, or has not, is left out."""
    out = set()
    for name in " ".join(values).split():
        before = ""
        for word in map(str.lower, _NAME.findall(name)):
            if before not in _LAYOUT_NAMES:
                out.add(word)
            before = word
    return out


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the structure says that an element is not part of the main text."""
    if tag in _BOILERPLATE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in _BOILERPLATE_ROLES:
        return True
    names = _names(found.get("class", ""), found.get("id", ""))
    if tag == "article":
        return bool(names & _ARTICLE_BOILERPLATE)
    return bool(names & _BOILERPLATE_NAMES) or (not in_article and bool(names & _HEADER_NAMES))


def _marks_article(tag: str, attributes: str) -> bool:
    if tag in ("article", "main"):
        return True
    if tag not in ("div", "section", "td") or not attributes.strip():
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if found.get("role") == "main" or found.get("itemprop") == "articlebody":
        return True
    return bool(_ARTICLE_NAMES & {*found.get("class", "").split(), *found.get("id", "").split()})


class _Open(NamedTuple):
    """An open element, with what holds inside it."""

    tag: str
    outside: bool
    article: int  # number of the marked article
    linked: bool
    in_article: bool  # within an ``article`` element


_ROOT = _Open("", False, 0, False, False)


class _Stack:
    """Open elements; how many there are of each tag tells at once whether a closing tag closes any."""

    def __init__(self) -> None:
        self.elements = [_ROOT]
        self.count: Counter = Counter()

    @property
    def top(self) -> _Open:
        return self.elements[-1]

    def push(self, element: _Open) -> None:
        self.elements.append(element)
        self.count[element.tag] += 1

    def pop(self) -> str:
        tag = self.elements.pop().tag
        self.count[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """End the innermost element of this tag and all within it."""
        if self.count[tag]:
            while self.pop() != tag:
                pass


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack = _Stack()
    articles = 0
    heading = False

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(linked, len(text)), stack.top.outside, stack.top.article, heading))
        parts.clear()
        linked, heading = 0, False

    def add(text: str) -> None:
        nonlocal linked
        text = references.unescape(text)
        parts.append(text)
        if stack.top.linked:
            linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not (tag := m["tag"]):
            if m["raw"]:
                parts.append(" ")
            continue
        tag = tag.lower()
        block = tag not in _INLINE
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["close"]:
            stack.close(tag)
            continue
        if tag in _VOID:
            continue
        if block and stack.top.tag in ("p", "li", "dt", "dd", "option") and (stack.top.tag == "p" or tag == stack.top.tag):
            stack.pop()
        while block and stack.top.tag in _INLINE and not stack.top.outside:
            stack.pop()  # an inline element that was never closed ends with its block
        if block and stack.top.tag == "p":
            stack.pop()
        around = stack.top
        outside, article = around.outside or _boilerplate(tag, m["attributes"], around.in_article), around.article
        if not outside and not article and _marks_article(tag, m["attributes"]):
            articles += 1
            article = articles
        heading = heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        stack.push(_Open(tag, outside, article, around.linked or tag == "a", around.in_article or tag == "article"))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def first_pass(block: Block, marked: bool) -> bool | None:
    """True for main text, False for boilerplate, None for open."""
    n = len(block.text)
    if block.outside or (marked and not block.article):
        return False
    if block.linked > LINKS * n:
        return None if block.article and n < SHORT else False
    if n < SHORT:
        return None
    if block.article:
        return True
    words = [_STRIP.sub("", w) for w in block.text.lower().split()]
    density = sum(w in _STOP_WORDS for w in words) / len(words)
    if density >= STOP_HIGH or (density >= STOP_LOW and n >= LONG):
        return True
    return None if density >= STOP_LOW or block.heading else False


def _neighbours(found: list[Block], labels: list[bool | None]) -> list[int]:
    """For each block the first one before it that is no boilerplate by structure and no open block of its article; -1 for none.

    One sweep: where that block would be an open one of the same article, it has the same neighbour.
    """
    out, last = [], -1  # the last block that is not boilerplate by structure
    for i, block in enumerate(found):
        same = last >= 0 and labels[last] is None and found[last].article == block.article
        out.append(out[last] if same else last)
        if not block.outside:
            last = i
    return out


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided block of their article, or of the page.

    Boilerplate by structure says nothing about what stands beside it. Between two equally near blocks that
    differ, an open block is main text in a marked article and boilerplate elsewhere.
    """
    out = []
    n = len(found)
    before = _neighbours(found, labels)
    after = [n - 1 - j if j >= 0 else n for j in reversed(_neighbours(found[::-1], labels[::-1]))]
    for i, label in enumerate(labels):
        if label is None:
            article = found[i].article
            near: list[tuple[int, bool]] = []
            for j in (before[i], after[i]):
                if 0 <= j < n and found[j].article == article:
                    near.append((abs(j - i), labels[j]))
                elif article:
                    near.append((n, True))
            if found[i].heading and len(near) == 2:
                label = near[1][1]  # a heading belongs to what follows
            elif near:
                least = min(d for d, _ in near)
                label = any(x for d, x in near if d == least) if article else all(x for d, x in near if d == least)
            else:
                label = found[i].linked == 0
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """Blocks of main text, one line each."""
    if not page:
        return ""
    found = blocks(page)
    marked = any(b.article and not b.outside for b in found)
    labels = second_pass(found, [first_pass(b, marked) for b in found])
    return "\n".join(b.text for b, keep in zip(found, labels) if keep)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, ``text`` and ``n_chars`` (code points) for every row.

    NULL, empty pages and pages without main text give an empty text. References are decoded, white space within a block is
    one space, blocks are joined by a line feed. An unclosed tag or comment swallows what follows it, as in a browser.
    """
    chosen = pages.select(*keep, F.col(html).cast("string").alias("page_html"))
    out = chosen.drop("page_html").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for (page,) in rows_of(batch, "page_html")]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"]
            )

    return chosen.mapInArrow(run, out)
