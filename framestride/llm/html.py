"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that never hold article text (scripts, forms, navigation, adverts,
comments and the like, by tag name, role, or the words of class and id) are cut; one that wraps the article or most of
the page's plain text, such as a form around the page, stays without its controls. Inside an article only whole classes,
ids and roles made up of such words count, and only where the content has many links or few characters per tag; those of
reader comments always go. For each remaining element the
composite text density is computed: characters per tag, adjusted by the share of characters and tags in links. The
density sum of an element adds up its children's densities; the element with the largest sum leads to the content.
The smallest density on its path to the body is the threshold: other elements that reach it bring their own largest sum
in. The content is the smallest element that holds all of these, widened to an article element around it.

Blocks are the runs of text between block-level tags; white space in a block becomes one space, blocks are joined by an
empty line.

Defined results: null or empty html and pages without text give an empty text; markup that does not close is closed at
the end; repeated rows are each extracted; null ids are kept. Other columns are not read.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head script style textarea title noscript iframe xmp noembed noframes template svg math canvas audio video "
    "button select option input nav footer menu".split()
)
#: Elements that hold no article text unless they wrap the page's text; a header only outside an article.
WRAPS = frozenset("form object aside dialog header".split())
#: Which open elements a start tag ends, up to the elements that stop the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class, id and role that mark boilerplate; the second set only outside an article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup paywall sidebar widget widgets "
    "related recommended menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer share sharing social "
    "comments comment commentlist disqus replies reply respond search login complementary contentinfo banner toolbar "
    "hidden".split()
)
OUTSIDE = frozenset("header masthead topbar".split())
#: Words that may stand beside those in a class or id inside an article.
BESIDE = frozenset("area articles bar block bottom box buttons button container content form icons inner item items left links list posts right section side slot stories top unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that mark where the article is.
ANCHORS = frozenset("article main h1".split())

#: Whole classes, ids and roles of reader comments; these go wherever they stand, however their text looks.
COMMENTS = frozenset(
    "comments comment-list commentlist comment-section comments-area comments-section comments-list comments-wrapper "
    "reader-comments user-comments post-comments disqus_thread replies responses respond".split()
)

#: Comments, sections and declarations; a tag whose quoted values may hold ``>``; a tag up to the next ``>``.
_DECLARED = re.compile(r"<!--(.*?)(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]+|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z]+|[0-9]+")


class Element:
    __slots__ = ("anchors", "articles", "attributes", "chars", "density", "items", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.items: list[Element | str] = []

    def children(self) -> list[Element]:
        return [x for x in self.items if isinstance(x, Element)]


class _Open:
    """The open elements, and where those of each tag and the blocks lie among them."""

    def __init__(self, root: Element):
        self.stack, self.at, self.blocks = [root], {}, []

    def push(self, e: Element) -> None:
        self.at.setdefault(e.tag, []).append(len(self.stack))
        if e.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > place:
            e = self.stack.pop()
            self.at[e.tag].pop()
            if e.tag not in INLINE:
                self.blocks.pop()

    def end(self, names: set[str], stops: set[str]) -> None:
        """Close the innermost of ``names`` unless one of ``stops`` is open inside it."""
        place = self.last(names)
        if place > self.last(stops):
            self.close(place)


def tree(html: str) -> Element:
    """The element tree of a page; the root stands for the document.

    The page is read once from front to back: the text of a script or the like is passed over whole, and no tag is looked
    for behind the last ``>``. Where a quoted value does not end, quotes no longer count in the rest.
    """
    root = Element("#root", None)
    opened = _Open(root)
    at, seek, last, loose = 0, 0, html.rfind(">"), False
    while True:
        seek = html.find("<", seek)
        if seek < 0:
            break
        declared = _DECLARED.match(html, seek)
        m = declared
        if m is None and seek < last:
            if not loose:
                m = _QUOTED.match(html, seek)
                loose = m is None and _LOOSE.match(html, seek) is not None
            if loose:
                m = _LOOSE.match(html, seek)
        if m is None:
            seek += 1
            continue
        if seek > at:
            opened.stack[-1].items.append(html[at:seek])
        at = seek = m.end()
        if declared is not None:
            if m.group(2) is not None:
                opened.stack[-1].items.append(m.group(2).replace("&", "&amp;"))
            continue
        name, attributes = m.group(2).lower(), m.group(3)
        if m.group(1):
            place = opened.last((name,))
            # An end tag of an inline element does not close a block that was opened inside it.
            if place and not (name in INLINE and opened.blocks and opened.blocks[-1] > place):
                opened.close(place)
            continue
        if name not in INLINE and name not in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            opened.end({"p"}, {"table", "td", "th", "button", "object", "caption"})
        if name in ENDS:
            opened.end(*ENDS[name])
        child = Element(name, opened.stack[-1], attributes)
        opened.stack[-1].items.append(child)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(html, at)
            stop = end.start() if end else len(html)
            child.items.append(html[at:stop])
            at = html.find(">", stop) + 1 if end else len(html)
            at = seek = at or len(html)
        elif name not in VOID and not attributes.endswith("/"):
            opened.push(child)
    if at < len(html):
        opened.stack[-1].items.append(html[at:])
    return root


def _order(root: Element) -> list[Element]:
    """All elements, parents before children."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo.extend(reversed(e.children()))
    return out


def _marks(tag: str, attributes: str) -> tuple[list[str], bool]:
    """Classes, ids and roles that may mark boilerplate, and whether the element is not shown."""
    marks: list[str] = []
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key in ("class", "role") or key == "id" and (tag != "section" or value in COMMENTS):
            marks.extend(value.split())
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return ([] if tag in HEADINGS else marks), hidden


def _hinted(marks: list[str], e: Element, article: Element | None) -> bool:
    """Whether classes, ids and roles mark an element as boilerplate; inside an article its content must look so too."""
    if article is None:
        return any(w in HINTS or w in OUTSIDE for mark in marks for w in _PART.findall(mark))
    if 3 * e.link_chars <= e.chars and 2 * e.chars * max(article.tags, 1) >= article.chars * max(e.tags, 1):
        return False
    for mark in marks:
        words = [w for w in _PART.findall(mark) if not w.isdigit()]
        if not HINTS.isdisjoint(words) and all(w in HINTS or w in BESIDE for w in words):
            return True
    return False


def _length(text: str) -> int:
    return len(text) - sum(map(text.count, " \t\n\r\f"))


def _measure(root: Element) -> None:
    """Characters, tags, and those inside links, of every element."""
    for e in reversed(_order(root)):
        e.chars = sum(_length(x) for x in e.items if isinstance(x, str)) if e.tag not in RAW else 0
        e.tags, e.link_chars, e.link_tags = 0, 0, 0
        e.anchors, e.articles = int(e.tag in ANCHORS), int(e.tag in ("article", "main"))
        for c in e.children():
            e.chars += c.chars
            e.tags += c.tags + 1
            e.link_chars += c.link_chars
            e.link_tags += c.link_tags
            e.anchors += c.anchors
            e.articles += c.articles
        if e.tag == "a":
            e.link_chars, e.link_tags = e.chars, e.tags + 1


def _without(root: Element, drop) -> bool:
    """Remove the elements that ``drop(element, article around it)`` names; whether there were any."""
    any_cut = False
    todo: list[tuple[Element, Element | None]] = [(root, None)]
    while todo:
        e, article = todo.pop()
        for k, x in enumerate(e.items):
            if isinstance(x, Element):
                if drop(x, article):
                    e.items[k] = Element("#gap", e)
                    any_cut = True
                else:
                    todo.append((x, x if x.tag in ("article", "main") else article))
    return any_cut


def _cut(root: Element) -> None:
    """Remove elements that hold no article text, the certain ones first; the rest is measured without them.

    A wrap or hint does not remove an element with most of the page's plain text, unless the page's headline or article
    element lies elsewhere. A form or object may stay with the headline elsewhere, and any wrap that holds all articles.
    """

    def most(x: Element) -> bool:
        return 2 * (x.chars - x.link_chars) > root.chars - root.link_chars

    def wraps(x: Element, article: Element | None) -> bool:
        if x.tag in WRAPS and (x.tag != "header" or article is None):
            if article is None and root.articles:
                return x.articles < root.articles and not (x.articles and most(x))
            return not (most(x) and (x.tag in ("form", "object") or x.anchors or not root.anchors))
        if article is None and x.attributes and not OUTSIDE.isdisjoint(w for m in _marks(x.tag, x.attributes)[0] for w in _PART.findall(m)):
            return x.tag not in ("html", "body", "article", "main") and x.articles == 0 and not most(x)
        return False

    def hints(x: Element, article: Element | None) -> bool:
        if not x.attributes or x.tag in ("html", "body", "article", "main") or x.tag in WRAPS and not (x.tag == "header" and article is not None):
            return False
        marks, hidden = _marks(x.tag, x.attributes)
        if not COMMENTS.isdisjoint(marks) and x.chars < root.chars:
            return True
        return (hidden or bool(marks) and _hinted(marks, x, article)) and not (most(x) and (x.anchors or not root.anchors))

    _without(root, lambda x, article: x.tag in NEVER)
    _measure(root)
    if _without(root, wraps):
        _measure(root)
    _without(root, hints)


def _densities(body: Element) -> None:
    """Composite text density, and the sum of the children's, of every element."""
    whole = body.link_chars / max(body.chars, 1)
    for e in reversed(_order(body)):
        if not e.chars:
            e.density = 0.0
        else:
            plain = max(e.chars - e.link_chars, 1)
            base = math.log(e.chars / plain * e.link_chars + whole * e.chars + math.e)
            tags, links, linked = max(e.tags, 1), max(e.link_tags, 1), max(e.link_chars, 1)
            e.density = e.chars / tags * max(math.log(max(e.chars / linked * tags / links, 1.0)) / max(math.log(max(base, 1.0 + 1e-9)), 1.0), 0.0)
        e.sum = sum(c.density for c in e.children())
        if not e.children():
            e.sum = e.density


def content(root: Element) -> Element | None:
    """The element that holds the main text, in a tree without boilerplate."""
    _measure(root)
    body = next((e for e in _order(root) if e.tag == "body"), root)
    if not body.chars:
        return None
    _densities(body)
    order = _order(body)
    parents = [e for e in order if e.children()]
    best = max(parents, key=lambda e: e.sum) if parents else body
    path = _path(best, body)
    threshold = min(e.density for e in path)
    depth = {id(x): k for k, x in enumerate(path)}
    inside = {id(x) for x in _order(best)}
    common = path
    for e in order:
        if id(e) not in inside and e.density >= threshold and id(e) not in depth and id(e.parent) in depth and e.chars > e.link_chars * 2:
            common = common[: depth[id(e.parent)] + 1]
    found = common[-1]
    above: Element | None = found
    while above is not None and above is not body.parent:
        if above.tag in ("article", "main"):
            return above
        above = above.parent
    inner = [e for e in _order(found) if e.tag in ("article", "main") and 2 * e.chars > found.chars]
    return inner[0] if inner else found


def _path(e: Element, body: Element) -> list[Element]:
    """From the body down to an element."""
    out = [e]
    while e is not body:
        e = e.parent
        out.append(e)
    return out[::-1]


def blocks(e: Element) -> list[str]:
    """Texts between block-level tags, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(markup.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[Element | str | None] = [e]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            block = x.tag not in INLINE
            if block:
                flush()
                todo.append(None)
            elif x.tag in ("br", "wbr", "img"):
                run.append(" " if x.tag == "br" else "")
            todo.extend(reversed(x.items))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = tree(html)
    _cut(root)
    found = content(root)
    return "\n\n".join(blocks(found)) if found is not None else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
