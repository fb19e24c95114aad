"""Web pages as trees of block elements, with the text blocks they own.

Inline elements are no nodes: their text belongs to the block around them.
A block of text ends where a block element begins or ends. Scripts, styles,
comments and markup have no text. ``<svg .../>`` is closed at once; elements
whose names only begin like those (``svg-icon``) are as all others."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_SPACE = " \t\n\r\f\v"
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements whose content is no markup; it ends with their own end tag.
RAW = frozenset("script style template noscript svg iframe textarea".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}

# Inline and void elements of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr br img input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An open element of the first kind ends where one of the others begins.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
BLOCK_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split())


class Scanner:
    """Tags of a page from left to right, in time that grows in proportion to
    the page, also where tags or quotes are never closed.

    A tag ends at the first ``>`` outside quotes; a quote without a partner is a
    character as any other. Where all that follows is within quotes the tag ends at
    the first ``>``. Quotes from which no such ``>`` can be reached are remembered,
    so a second try stops there."""

    def __init__(self, source: str):
        self.source = source
        self.places = {c: [m.start() for m in re.finditer(c, source)] for c in (">", '"', "'")}
        self.hopeless: set[int] = set()

    def after(self, mark: str, at: int) -> int:
        """The next place of ``mark`` from ``at`` on, or the page's length."""
        places = self.places[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else len(self.source)

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if the page's end
        cuts it off."""
        n, tried = len(self.source), []
        first = self.after(">", at)
        if first == n:
            return -1
        while True:
            close, double, single = (self.after(c, at) for c in (">", '"', "'"))
            quote = min(double, single)
            if close < quote:
                return close + 1
            if quote == n or quote in self.hopeless:
                self.hopeless.update(tried)
                return first + 1
            tried.append(quote)
            partner = self.after(self.source[quote], quote + 1)
            at = partner + 1 if partner < n else quote + 1

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes) of each piece of
        markup; the name is empty for comments, raw elements and the like."""
        source, n = self.source, len(self.source)
        at = source.find("<")
        while 0 <= at < n:
            end, name, closes, attributes = at, "", False, ""
            after = source[at + 1:at + 2]
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                end = n if end < 0 else end + 3
            else:
                closes = after == "/"
                m = _NAME.match(source, at + 1 + closes)
                if m:
                    name = m.group().lower()
                    end = self.tag_end(m.end())
                    if end < 0 or not closes and name in RAW and source[m.end():m.end() + 1] in (*_SPACE, "/", ">"):
                        end, name = self._raw_end(name, m.end(), end, closes), ""
                    if name:
                        attributes = source[m.end():end - 1]
                elif after and after in "!?/":
                    end = min(n, self.after(">", at) + 1)
            if end > at:
                yield at, end, name, closes, attributes
                at = end
            else:
                at += 1
            at = source.find("<", at)

    def _raw_end(self, name: str, at: int, end: int, closes: bool) -> int:
        """The end of a raw element, or of a tag that is cut off (0: the
        bracket is text)."""
        if end < 0:
            return len(self.source) if closes else 0
        if name == "svg" and self.source[end - 2] == "/":
            return end
        m = _RAW_END[name].search(self.source, self.after(">", at) + 1)
        return m.end() if m else len(self.source)


@dataclass
class Node:
    tag: str
    parent: int
    names: str  # class, id and role values
    chars: int = 0
    link_chars: int = 0
    blocks: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    #: (owning node, text) in page order.
    blocks: list[tuple[int, str]]


class Stack:
    """Open elements (numbers of nodes), and where those of each name are."""

    def __init__(self):
        self.tags, self.nodes = ["page"], [0]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def last(self, tags) -> int:
        """The place of the innermost element of one of these names, 0 if none
        is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        for tag in self.tags[place:]:
            self.places[tag].pop()
        del self.tags[place:], self.nodes[place:]


#: An open element ends only within the innermost of these.
HOLDS = ("ul", "ol", "dl", "table", "select", "div", "section")
#: By a beginning element, those that it ends.
ENDED = {tag: tuple(o for o, by in ENDS.items() if tag in by) for tag in ENDS}


def parse(source: str) -> Page:
    """The tree of a page; node 0 stands for the page."""
    nodes, blocks, stack = [Node("page", -1, "")], [], Stack()
    run: list[str] = []
    links = run_links = 0

    def finish() -> None:
        nonlocal run_links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                node = nodes[stack.nodes[-1]]
                node.chars += len(text)
                node.link_chars += min(len(text), run_links)
                node.blocks.append(len(blocks))
                blocks.append((stack.nodes[-1], text))
            run.clear()
        run_links = 0

    def words(piece: str) -> None:
        nonlocal run_links
        run.append(piece)
        if links:
            run_links += len(piece)

    at = 0
    for start, end, tag, closes, attributes in Scanner(source).tags():
        if start > at:
            words(source[at:start])
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closes else 1))
            elif tag == "br":
                run.append(" ")
            continue
        finish()
        if closes:
            if place := stack.last((tag,)):
                stack.cut(place)
                links = 0
            continue
        if tag in BLOCK_ENDS_P:
            # An open paragraph ends here, with the inline text in it.
            if stack.tags[-1] == "p":
                stack.cut(len(stack.tags) - 1)
        elif tag in ENDED:
            place = stack.last(ENDED[tag])
            if place > stack.last(HOLDS):
                stack.cut(place)
        if tag in VOID:
            continue
        names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
        nodes.append(Node(tag, stack.nodes[-1], names))
        stack.push(tag, len(nodes) - 1)
        links = 0
    if at < len(source):
        tail = source[at:]
        cut = re.search(r"<[a-zA-Z/!][^<]*\Z", tail)  # a tag that the page's end cuts off
        words(tail[:cut.start()] if cut else tail)
    finish()
    return Page(nodes, blocks)
