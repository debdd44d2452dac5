"""Article extraction and sanitizing on parsed markup, as column functions.

Tags are matched by a parser, so nested elements, broken markup and tags inside
attributes are read as they are meant.  Pages are independent rows: Spark deals
them out, and a task holds a hundred pages and the tree of one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content; elements that a start tag of the same group ends; what breaks a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_SIBLING = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never part of an article, or never safe.
CHROME = frozenset("nav header footer aside form".split())
UNSAFE = frozenset("script style noscript template iframe object embed svg math title head select textarea button".split())
#: What sanitized markup may keep: elements, and their attributes.
ALLOWED = frozenset("a abbr b blockquote br caption cite code col colgroup dd del div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s samp small span strong sub sup table tbody td tfoot th thead tr u ul var".split())
ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title", "width", "height"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan"), "ol": ("start",)}
ADDRESS = re.compile(r"(?i)^(?:https?:|mailto:|[^:/?#]*(?:[/?#]|$))")
DEPTH = 400


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Builder(HTMLParser):
    """The tree of a page; what is nested deeper than DEPTH is laid flat, but for what is unsafe, which goes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", [])]
        self.deep: list[str] = []  # elements below DEPTH that are open

    def handle_starttag(self, tag, attrs):
        if not self.deep and (self.open[-1].tag in CLOSED_BY_SIBLING.get(tag, ()) or (self.open[-1].tag == "p" and tag in BLOCKS)):
            self.open.pop()
        if len(self.open) >= DEPTH:
            if tag not in VOID:
                self.deep.append(tag)
            elif not self._unsafe():
                self.open[-1].children.append(Node(tag, attrs))
            return
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        if not self._unsafe():
            self.open[-1].children.append(Node(tag, attrs))

    def handle_endtag(self, tag):
        # Where one like it is open below DEPTH, it closes that, and nothing outside.
        if tag in self.deep:
            del self.deep[len(self.deep) - 1 - self.deep[::-1].index(tag) :]
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                self.deep.clear()
                return

    def handle_data(self, data):
        if not self._unsafe():
            self.open[-1].children.append(data)

    def _unsafe(self) -> bool:
        return any(tag in UNSAFE for tag in self.deep)


class _Images(HTMLParser):
    """Start tags of images: place in the page, text, source."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.found: list[tuple[int, str, str]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        src = dict(reversed(attrs)).get("src")  # of several the first counts
        if tag == "img" and src is not None:
            line, column = self.getpos()
            self.found.append((self.lines[line - 1] + column, self.get_starttag_text(), src))


def image_sources_of(html: str) -> list[str]:
    """Sources of all images of a page, in order: quoted or not, but none in comments or scripts."""
    return [src for _, _, src in _Images(html).found]


_SOURCE = re.compile(r"""(?is)(\ssrc\s*=\s*)("[^"]*"|'[^']*'|[^\s>]+)""")


def with_sources(html: str, targets: dict[str, str]) -> str:
    """The page with the sources of some images replaced; all else stays as it is."""
    out, at = [], 0
    for place, tag, src in _Images(html).found:
        if src in targets:
            # A function, as the text of an address is no template.
            changed = _SOURCE.sub(lambda m, to=targets[src]: f'{m[1]}"{escape(to)}"', tag, count=1)
            out += [html[at:place], changed]
            at = place + len(tag)
    return "".join([*out, html[at:]])


def title_of(html: str) -> str | None:
    """Text of the first title that has some."""
    stack = [parsed(html)]
    while stack:
        node = stack.pop()
        if node.tag == "title":
            text = re.sub(r"\s+", " ", "".join(c for c in node.children if isinstance(c, str))).strip()
            if text:
                return text
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and c.tag != "svg"]
    return None


@lru_cache(maxsize=1)
def parsed(html: str) -> Node:
    """The tree of a page; that of the last one is kept for the next question about it, so none may change it."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.open[0]


@lru_cache(maxsize=1)
def article(html: str) -> Node:
    """The element that holds the article, kept like the tree."""
    from . import readability  # which reads this module's tables

    return readability.article(parsed(html))


def _text(node: Node, out: list[str]) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.append(child)
        elif child.tag not in UNSAFE and child.tag not in CHROME:
            block = child.tag in BLOCKS or child.tag == "br"
            out.append(" " if block else "")
            _text(child, out)
            out.append(" " if block else "")


def _clean(node: Node, out: list[str]) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.append(escape(child, quote=False))
        elif child.tag in UNSAFE:
            continue
        elif child.tag not in ALLOWED:
            _clean(child, out)
        else:
            kept = [(k, v or "") for k, v in child.attrs if k in ATTRIBUTES.get(child.tag, ())]
            kept = [(k, v) for k, v in kept if k not in ("href", "src") or ADDRESS.match(re.sub(r"[\x00-\x20]+", "", v))]
            out.append(f"<{child.tag}{''.join(f' {k}="{escape(v)}"' for k, v in kept)}>")
            if child.tag not in VOID:
                _clean(child, out)
                out.append(f"</{child.tag}>")


def sanitize(html: str) -> str:
    """Only allowed elements, attributes and addresses; other elements give way to their content, unsafe ones go whole."""
    out: list[str] = []
    _clean(parsed(html), out)
    return "".join(out)


def text_of(html: str) -> str:
    out: list[str] = []
    _text(article(html), out)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def article_of(html: str) -> str:
    out: list[str] = []
    _clean(article(html), out)
    return "".join(out).strip()


def each(function: Callable, returns: str, *columns: Column | str) -> Column:
    """A function of pages as a column; null for a null page.

    Rows go to Python by the hundred, not by the ten thousand of an Arrow
    batch, as a page may be large; all such columns of a row share one worker.
    """

    def run(page, *others):
        return None if page is None else function(page, *others)

    return F.udf(run, returns, useArrow=False)(*columns)


def article_text(html: Column | str) -> Column:
    """Text of the article, a blank for each block, white space folded; null for null."""
    return each(text_of, "string", html)


def article_html(html: Column | str) -> Column:
    """The article's markup, sanitized; null for null."""
    return each(article_of, "string", html)


def sanitized(html: Column | str) -> Column:
    return each(sanitize, "string", html)
