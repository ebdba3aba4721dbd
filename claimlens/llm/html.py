"""Main text of web pages by tag-path ratios.

Every piece of text has the path of block tags from the root to it. Per path of a page the text length and the punctuation
are totalled and divided by the number of pieces; the two ratios are fused, smoothed along the page, and paths above the
page's standard deviation are content. The article is the element that holds the content pieces; all text in it counts,
without what is marked as menu, header, footer, sidebar, notice, advert, form or reader comment.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import blocks

#: Elements without content, and elements whose content is no markup.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp"}
#: Elements that are never part of an article.
OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video"} | RAW
#: Elements inside a line of text; all others begin and end blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span",
          "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Elements that may hold an article.
HOLDERS = {"html", "body", "main", "article", "section", "div", "td", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a start tag of the same kind, or of a block for p, ends.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"html", "body", "main", "article", "section", "div", "table", "ul", "ol", "dl", "blockquote", "aside", "nav", "footer", "header", "form", "td", "th"}
_MARKS = (r"ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscri\w*|share|sharing|social|related|recommend\w*"
          r"|sidebar|side|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|comments?|commentlist|disqus|replies|pagination|pager|widgets?|toolbar|skip|login|signup|search")
_MARKED = re.compile(rf"(?:^|[\s_-])(?:{_MARKS})(?:$|[\s_-])", re.I)
#: Inside an article a name must say nothing else: marks, and what they are marks of.
_THINGS = "area|articles|bar|block|box|button|buttons|container|content|form|group|inner|items?|links?|list|panel|posts?|section|slot|stories|thread|unit|wrap|wrapper"
_MARKED_INSIDE = re.compile(rf"(?:^|\s)(?:(?:{_THINGS})[_-])*(?:{_MARKS})(?:[_-](?:{_MARKS}|{_THINGS}|\d+))*(?:$|\s)", re.I)
_NO_ARTICLE = re.compile(rf"(?:^|\s)(?:ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|comments?|repl(?:y|ies)|teaser)(?:[_-](?:{_THINGS}|\d+))*(?:$|\s)", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：،؟।]")


class _Element:
    """An open or closed element; ``no`` to ``last`` are the numbers of its descendants, ``path`` a number of its tag path."""

    __slots__ = ("tag", "up", "outside", "path", "inline", "block", "no", "last", "depth", "weight")

    def __init__(self, tag: str, up: _Element | None, outside: bool, no: int, paths: dict):
        self.tag, self.up, self.outside, self.no, self.last = tag, up, outside, no, no
        self.inline, self.depth, self.weight = tag in INLINE, 0 if up is None else up.depth + 1, 0.0
        self.block = up.block if self.inline else self
        self.path = up.path if self.inline else paths.setdefault((None if up is None else up.path, tag), len(paths))


def _aside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is marked as something beside the article; ``inside`` an article, ids of headings are anchors."""
    if tag in OUTSIDE:
        return True
    if tag in ("html", "body", "main") or not attributes.strip(" /"):
        return False
    if tag == "article":  # a comment or a card, else never beside itself
        return any(name.lower() == "class" and _NO_ARTICLE.search(unescape("".join(values))) for name, *values in _ATTRIBUTE.findall(attributes))
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape("".join(values))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES:
            return True
        if (name == "class" or name == "id" and not (inside and tag in HEADINGS)) and (_MARKED_INSIDE if inside else _MARKED).search(value):
            return True
    return False


def pieces(page: str) -> tuple[list[_Element], list[tuple[_Element, str]]]:
    """All elements, parents first, and the blocks of text in page order with the block element they stand in."""
    paths: dict = {}
    root = _Element("", None, False, 0, paths)
    every, out, text, opened = [root], [], [], {}
    here = owner = root

    def flush():
        block = " ".join(unescape("".join(text)).split())
        if block:
            out.append((owner, block))
        text.clear()

    def add(s: str):
        nonlocal owner
        if not text:
            owner = here.block
        if here.outside and not owner.outside:  # marked inline elements inside a block
            return
        text.append(s)

    def leave(tags: set[str], stop: set[str]) -> None:
        """Closes the innermost open element of ``tags``, with all in it, unless one of ``stop`` stands before it."""
        nonlocal here
        if not any(opened.get(t) for t in tags):
            return
        e = here
        while e is not root and (e.tag in tags or e.tag not in stop):
            if e.tag in tags:
                close(e.up)
                return
            e = e.up

    def close(e: _Element) -> None:
        nonlocal here
        while here is not e:
            opened[here.tag] -= 1
            here = here.up

    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        if mark > at:
            add(page[at:mark])
        if mark == end:
            break
        if page.startswith("<!--", mark):
            stop = page.find("-->", mark + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[mark + 1 : mark + 2] in ("!", "?"):
            stop = page.find(">", mark)
            at = end if stop < 0 else stop + 1
            continue
        name = _NAME.match(page, mark + 1)
        if not name:
            if page[mark + 1 :] in ("", "/"):  # a tag cut off by the page's end
                break
            add("<")
            at = mark + 1
            continue
        rest = _REST.match(page, name.end())
        stop = rest.end() if rest else page.find(">", name.end()) + 1
        if not stop:
            break
        tag, closing, at = name[1].lower(), page[mark + 1] == "/", stop
        if tag not in INLINE and tag not in RAW and tag not in ("br", "wbr", "img"):
            flush()
        elif tag == "br":
            add(" ")
        if closing:
            if tag not in VOID:
                leave({tag}, set() if tag in _SCOPE else _SCOPE)
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, at)
            at = found.start() if found else end
            if found:
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            leave({"p"}, _SCOPE)
            if tag in _SIBLINGS:
                leave(_SIBLINGS[tag], _SCOPE - {"td", "th"} if tag == "tr" else _SCOPE - _SIBLINGS[tag])
            close(here.block)  # blocks end what is open inside a line
        here = _Element(tag, here, here.outside or _aside(tag, page[name.end() : stop - 1], bool(opened.get("article") or opened.get("main"))), len(every), paths)
        every.append(here)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return every, out


def path_ratios(paths: list[int], blocks: list[str], width: int = 2) -> np.ndarray:
    """Fused and smoothed ratio of every block: text length times punctuation per piece of its path."""
    names, where = np.unique(paths, return_inverse=True)
    count = np.bincount(where)
    length = np.bincount(where, weights=[len(b) for b in blocks]) / count
    marks = np.bincount(where, weights=[len(_PUNCTUATION.findall(b)) for b in blocks]) / count
    fused = (length * (0.1 + marks))[where]
    kernel = np.exp(-(np.arange(-width, width + 1) ** 2) / 2.0)
    smooth = np.convolve(np.pad(fused, width), kernel)[2 * width : 2 * width + len(fused)] / np.convolve(np.pad(np.ones(len(fused)), width), kernel)[2 * width : 2 * width + len(fused)]
    # a path is judged as a whole, so short pieces of a content path stay
    return (np.bincount(where, weights=np.sqrt(smooth * fused)) / count)[where]


def article(page: str) -> str:
    """The article's blocks, one per line; empty if there is no text outside menus, headers, footers and the like.

    Blocks of paths that pass the threshold are content wherever they stand; so is all that stands with content in articles
    or, where these do not hold most of it, in the innermost element that holds nearly all.
    """
    every, found = pieces(page)
    found = [(e, b) for e, b in found if not e.outside]
    if not found:
        return ""
    ratio = path_ratios([e.path for e, _ in found], [b for _, b in found])
    content = ratio >= min(ratio.std(), ratio.max())
    for (e, b), good in zip(found, content):
        e.weight += len(b) * bool(good)
    # weight of the content in every element, and its last descendant
    for e in reversed(every[1:]):
        e.up.weight += e.weight
        e.up.last = max(e.up.last, e.last)
    total = every[0].weight
    holders = []
    for tag in ("article", "main"):
        named, reach = [], -1
        for e in every:
            if e.tag == tag and not e.outside and e.weight and e.no > reach:  # not inside another one
                named.append(e)
                reach = e.last
        if named and sum(e.weight for e in named) >= 0.5 * total:
            holders = named
            break
    if not holders:
        holders = [max((e for e in every if (e.tag in HOLDERS or e.up is None) and e.weight >= 0.9 * total), key=lambda e: e.depth)]
    inside = np.zeros(len(every) + 1, dtype=np.int64)
    for e in holders:
        inside[e.no] += 1
        inside[e.last + 1] -= 1
    inside = np.cumsum(inside)
    return "\n".join(b for (e, b), good in zip(found, content) if good or inside[e.no])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """(row, text, n_chars): every row as a struct of its columns, its main text and the number of code points.

    Null and empty html give an empty text; markup that the page's end cuts off is dropped, elements left open end there.
    Repeated rows give the same text; other columns pass through.
    """
    blocks.bound_batches(pages.sparkSession)
    rows = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"))

    def batches(it):
        for b in it:
            texts = [article(x) if x else "" for x in b["row"].field(html).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["row", "text", "n_chars"])

    return rows.mapInArrow(batches, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long")
