"""The article of a page: paragraphs vote for what holds them.

A paragraph with enough text has points for its commas and its length, by the
share of its text that is no link, and gives them to its parent in full, to its grandparent by half and to further
ancestors by less.  Elements start with points for what they are and for hints
in their class and id.  Points count by the share of text that is no link; the
element with the most is the article.  Siblings that score well beside it, or
are paragraphs of text, join it.  Elements whose class or id says that they
are page furniture take no part; if too little text is found so, the hints are
dropped one after the other, and of all tries the one with the most text wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .markup import BLOCKS, CHROME, UNSAFE, Node

#: What class and id hint at.
FURNITURE = re.compile(r"(?i)ad-break|agegate|banner|breadcrumb|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|pager|pagination|popup|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|yom-remote")
MAYBE = re.compile(r"(?i)and|article|body|column|content|main|mathjax|shadow")
GOOD = re.compile(r"(?i)article|blog|body|content|entry|h-?entry|hentry|main|page|post|story|text")
BAD = re.compile(r"(?i)-ad-|banner|combx|comment|com-|contact|footer|gdpr|hidden|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget")
#: Points of elements, and of a hint.
POINTS = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, **dict.fromkeys("address ol ul dl dd dt li form".split(), -3), **dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)}
HINT = 25
#: Characters of a paragraph at least, of an article that is taken at once, and of a sibling paragraph that may hold links.
PARAGRAPH, ENOUGH, SIBLING = 25, 500, 80
_SCORED = frozenset("p td pre section h2 h3 h4 h5 h6".split())


def hints(node: Node) -> str:
    return " ".join(v for k, v in node.attrs if k in ("class", "id") and v)


def text_length(node: Node) -> tuple[int, int]:
    """Characters of text below a node, and those of links."""
    chars = links = 0
    stack: list[tuple[Node, bool]] = [(node, node.tag == "a")]
    while stack:
        at, linked = stack.pop()
        for child in at.children:
            if isinstance(child, str):
                n = len(re.sub(r"\s+", " ", child).strip())
                chars += n
                links += n if linked else 0
            elif child.tag not in UNSAFE:
                stack.append((child, linked or child.tag == "a"))
    return chars, links


def link_density(node: Node) -> float:
    chars, links = text_length(node)
    return links / chars if chars else 0.0


class _Page:
    """The elements of a page that may be part of an article, with their parents and points."""

    def __init__(self, root: Node, strict: bool, weighed: bool) -> None:
        self.weighed = weighed
        self.parent: dict[int, Node] = {}
        self.nodes: list[Node] = []
        self.left_out: set[int] = set()
        stack = [root]
        while stack:
            node = stack.pop()
            self.nodes.append(node)
            for child in node.children:
                if isinstance(child, str):
                    continue
                about = hints(child)
                out = child.tag in UNSAFE or child.tag in CHROME
                out |= strict and child.tag not in ("body", "a", "article", "main") and bool(FURNITURE.search(about)) and not MAYBE.search(about)
                if out:
                    self.left_out.add(id(child))
                else:
                    self.parent[id(child)] = node
                    stack.append(child)
        self.points: dict[int, float] = {}
        self.candidates: dict[int, Node] = {}

    def ancestors(self, node: Node) -> Iterator[Node]:
        while (above := self.parent.get(id(node))) is not None:
            yield above
            node = above

    def start(self, node: Node) -> float:
        points = POINTS.get(node.tag, 0)
        if self.weighed:
            about = hints(node)
            points += HINT * (bool(GOOD.search(about)) - bool(BAD.search(about)))
        return points

    def text(self, node: Node) -> str:
        """The text of a node without what is left out."""
        out: list[str] = []
        # No nested function, as one that calls itself would keep the tree until the next collection of cycles.
        stack: list[Node | str] = [node]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                stack += [c for c in reversed(at.children) if isinstance(c, str) or id(c) not in self.left_out]
        return re.sub(r"\s+", " ", "".join(out)).strip()

    def is_paragraph(self, node: Node) -> bool:
        """A paragraph, or a div that holds text but no blocks."""
        if node.tag in _SCORED:
            return True
        return node.tag == "div" and not any(not isinstance(c, str) and c.tag in BLOCKS for c in node.children)

    def best(self) -> Node | None:
        for node in self.nodes:
            if not self.is_paragraph(node) or len(text := self.text(node)) < PARAGRAPH:
                continue
            worth = 2 + len(re.findall(r"[,،﹐︐︑⸁⸴⸲，]", text)) + min(len(text) // 100, 3)
            worth *= 1 - link_density(node)
            for level, above in enumerate(self.ancestors(node)):
                if level > 4:
                    break
                if id(above) not in self.points:
                    self.points[id(above)] = self.start(above)
                    self.candidates[id(above)] = above
                self.points[id(above)] += worth / (1, 2, 6, 9, 12)[level]
        for key, node in self.candidates.items():
            self.points[key] *= 1 - link_density(node)
        # Of equal ones the one that was found first, which is the outer.
        return max(self.candidates.values(), key=lambda n: self.points[id(n)], default=None)

    def article(self) -> Node | None:
        top = self.best()
        if top is None:
            return None
        # An only child speaks for its parent.
        while (above := self.parent.get(id(top))) is not None and above.tag not in ("body", "html", "") and sum(not isinstance(c, str) for c in above.children) == 1:
            top = above
        above = self.parent.get(id(top))
        least = max(10.0, 0.2 * self.points.get(id(top), 0.0))
        parts: list[Node | str] = []
        for sibling in above.children if above is not None else [top]:
            if isinstance(sibling, str) or id(sibling) in self.left_out:
                continue
            bonus = 0.2 * self.points.get(id(top), 0.0) if hints(sibling) and hints(sibling) == hints(top) else 0.0
            joins = sibling is top or self.points.get(id(sibling), float("-inf")) + bonus >= least
            if not joins and sibling.tag == "p":
                text, density = self.text(sibling), link_density(sibling)
                joins = density < 0.25 if len(text) > SIBLING else bool(text) and density == 0 and bool(re.search(r"\.( |$)", text))
            if joins:
                parts.append(sibling)
        out = Node("div", [])
        out.children = [self.kept(p) for p in parts]
        return out

    def kept(self, node: Node) -> Node:
        """A copy of a node without what is left out."""
        out = Node(node.tag, node.attrs)
        out.children = [c if isinstance(c, str) else self.kept(c) for c in node.children if isinstance(c, str) or id(c) not in self.left_out]
        return out


def article(root: Node) -> Node:
    """The article of a parsed page; the whole page where nothing stands out."""
    tries = []
    for strict, weighed in ((True, True), (False, True), (False, False)):
        found = _Page(root, strict, weighed).article()
        if found is None:
            continue
        n = text_length(found)[0]
        if n >= ENOUGH:
            return found
        tries.append((n, -len(tries), found))
    # Short pages: the try with the most text, of equal ones the strictest.
    return max(tries, key=lambda t: t[:2])[2] if tries and max(tries)[0] else root
