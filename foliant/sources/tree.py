"""Markup as a tree, on the standard library's parser.

Recovery: void elements hold nothing; a block start closes an open paragraph, list items, cells, rows and definition
terms close their like; an end tag without its start is left out, and one with it closes what stands open inside.
An element deeper than DEEPEST closes the one above it and stands beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whose start ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: tag: (what its start closes, what that is looked for within)
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Text that isn't shown.
UNSHOWN = frozenset({"script", "style", "template"})
DEEPEST = 200


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def descendants(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for child in self.elements():
            yield child
            yield from child.descendants()

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.descendants() if n.tag in tags)

    def first(self, tag: str) -> Node | None:
        return next(self.find(tag), None)

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in UNSHOWN:
                yield from child.strings()

    def text(self) -> str:
        return "".join(self.strings())

    def words(self) -> str:
        """Each string stripped, empty ones left out, parted by a space."""
        return " ".join(s for s in (x.strip() for x in self.strings()) if s)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.depth = 0

    def _up_to(self, node: Node | None) -> None:
        while self.at is not node:
            self.at, self.depth = self.at.parent, self.depth - 1

    def _close(self, tags: set[str] | frozenset[str], within: set[str] = frozenset()) -> None:
        node, found = self.at, None
        while node is not None and node.tag not in within:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            self._up_to(found.parent)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and any(n.tag == "p" for n in (self.at, *self.at.ancestors())):
            self._close({"p"}, {"li", "td", "th", "blockquote", "figure"} if tag != "p" else {"li", "td", "th", "blockquote"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if self.depth >= DEEPEST:
            self._up_to(self.at.parent)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self._up_to(node.parent)

    def handle_data(self, data):
        held = self.at.children
        if held and isinstance(held[-1], str):
            held[-1] += data
        else:
            held.append(data)


def parse(markup: str) -> Node:
    """The root of a tree; it has no tag of its own."""
    builder = _Builder()
    builder.feed(re.sub(r"<\?xml[^>]*\?>", "", markup, count=1))
    builder.close()
    return builder.root
